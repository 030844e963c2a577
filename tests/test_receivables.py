"""The life of a charge."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

import builders as b
from cargoledger import schemas
from cargoledger.operators import receivables, reports

MONTH, NOW = "2026-05", "2026-06-01 08:00:00"


def recon(spark, rows):
    return b.frame(spark, schemas.RECONCILIATION, [{"ship_month": MONTH, "is_return": False} | r for r in rows])


def by_seller(df):
    return {r["seller_id"]: r for r in df.collect()}


def test_generation_rules(spark):
    rows = [
        {"seller_id": 1, "client": "C", "account_type": "credit", "income": 100, "extra": 0},
        {"seller_id": 1, "client": "C", "account_type": "credit", "income": None, "extra": 0},
        {"seller_id": 2, "client": "P", "account_type": "prepaid", "income": 50, "extra": 0.3},
        {"seller_id": 2, "client": "P", "account_type": "prepaid", "income": 50, "extra": 0.6},
        {"seller_id": 3, "client": "Q", "account_type": "prepaid", "income": 50, "extra": 0.5},
        {"seller_id": 4, "client": "I", "account_type": "internal", "income": 50, "extra": 9},
    ]
    found = by_seller(receivables.generate_charges(recon(spark, rows), MONTH))
    assert set(found) == {1, 2}
    assert (found[1]["concept"], found[1]["waybills"], float(found[1]["amount"])) == ("invoice", 1, 100)
    assert (found[2]["concept"], found[2]["waybills"], float(found[2]["amount"])) == ("extra", 1, 0.9)


def test_merge_keeps_the_cycle_and_drops_stale_ones(spark):
    old = b.charges(spark, [
        {"seller_id": 1, "month": MONTH, "amount": 5, "status": "partial", "paid_amount": 3, "note": "n"},
        {"seller_id": 2, "month": MONTH, "amount": 5, "status": "generated"},
        {"seller_id": 3, "month": MONTH, "amount": 5, "status": "sent"},
        {"seller_id": 2, "month": "2026-04", "amount": 5, "status": "generated"},
    ])
    fresh = receivables.generate_charges(
        recon(spark, [
            {"seller_id": s, "client": f"c{s}", "account_type": "credit", "income": 7} for s in (1, 9)
        ]),
        MONTH,
    )
    merged = receivables.merge_charges(old, fresh, NOW, MONTH)
    found = {(r["seller_id"], r["month"]): r for r in merged.collect()}
    assert set(found) == {(1, MONTH), (3, MONTH), (2, "2026-04"), (9, MONTH)}
    kept, new = found[1, MONTH], found[9, MONTH]
    assert (kept["status"], float(kept["amount"]), float(kept["paid_amount"]), kept["note"]) == (
        "partial", 7, 3, "n")
    assert (new["status"], new["client"], float(new["paid_amount"])) == ("generated", "c9", 0)


@pytest.mark.parametrize(
    ("paid", "before", "after"),
    [(99.5, "sent", "paid"), (99.49, "sent", "partial"), (0, "approved", "approved"),
     (0, "paid", "sent"), (0, "generated", "generated")],
)
def test_recompute(spark, paid, before, after):
    charge = b.charges(spark, [{"seller_id": 1, "month": MONTH, "amount": 100, "status": before}])
    money = [{"payment_id": 1, "seller_id": 1, "month": MONTH, "amount": paid}] if paid else []
    row = receivables.recompute_charges(charge, b.payments(spark, money)).first()
    assert row["status"] == after and float(row["paid_amount"]) == paid


def test_payments_touch_only_their_charges_and_can_be_voided(spark):
    charge = b.charges(spark, [
        {"seller_id": s, "month": MONTH, "amount": 10, "status": "disputed"} for s in (1, 2)
    ])
    batch = b.payments(spark, [{"payment_id": 5, "seller_id": 1, "month": MONTH, "amount": 10}])
    after, paid = receivables.record_payments(b.payments(spark), batch, charge)
    assert {k: r["status"] for k, r in by_seller(paid).items()} == {1: "paid", 2: "disputed"}
    left, undone = receivables.void_payments(after, batch, paid)
    assert left.count() == 0
    assert {k: r["status"] for k, r in by_seller(undone).items()} == {1: "sent", 2: "disputed"}


@pytest.mark.parametrize(("days", "due"), [(0, 30), (None, 30), (45, 45)])
def test_due_date(spark, days, due):
    charge = b.charges(spark, [{"seller_id": 1, "month": MONTH, "amount": 1, "status": "generated"}])
    sent = spark.createDataFrame([(1, MONTH, None)], "seller_id long, month string, sent_on date")
    day = dt.date(2026, 6, 1)
    row = receivables.send_charges(
        charge, sent, b.config(spark, [{"seller_id": 1, "credit_days": days}]), day
    ).first()
    assert (row["status"], row["sent_date"]) == ("sent", day)
    assert row["due_date"] == day + dt.timedelta(days=due)


def test_days_overdue(spark):
    due = dt.date(2026, 6, 1)
    rows = [
        {"seller_id": 1, "month": MONTH, "amount": 9, "status": "sent", "due_date": due},
        {"seller_id": 2, "month": MONTH, "amount": 9, "status": "paid", "due_date": due},
        {"seller_id": 3, "month": MONTH, "amount": 9, "status": "sent"},
    ]
    attached = b.frame(spark, schemas.CHARGE_ATTACHMENTS, [{"seller_id": 1, "month": MONTH}] * 2)
    listed = by_seller(receivables.list_charges(
        b.charges(spark, rows), b.payments(spark), attached, dt.date(2026, 6, 11)))
    assert [listed[s]["days_overdue"] for s in (1, 2, 3)] == [10, 0, 0]
    assert [listed[s]["has_attachment"] for s in (1, 2, 3)] == [True, False, False]


def test_statement_splits_tax_and_surcharges(spark):
    lines = b.invoices(spark, [b.line("W", 1, kilos=1.2), b.line("E", 1)])
    rows = recon(spark, [
        {"waybill": "W", "seller_id": 1, "income": 232, "surcharges": 116, "extra": 0,
         "carrier": "dhl", "has_cost": True},
        {"waybill": "E", "seller_id": 2, "income": 500, "surcharges": 0, "extra": 11.6,
         "carrier": "dhl", "has_cost": True},
    ])
    charge = b.charges(spark, [{"seller_id": 2, "month": MONTH, "concept": "extra"}])
    statement = receivables.client_statement(charge, rows, lines)
    found = by_seller(statement)
    first = found[1]
    assert (float(first["total"]), float(first["subtotal"]), float(first["tax"])) == (116, 100, 16)
    assert first["billable_kilos"] == 2 and float(found[2]["total"]) == 11.6
    costs = b.surcharges(spark, [
        {"carrier": c, "waybill": w, "concept": "z", "amount": 50}
        for c, w in (("dhl", "W"), ("dhl", "W"), ("fedex", "W"), ("dhl", "E"))
    ])
    extra = receivables.statement_surcharges(
        charge, rows, costs, b.config(spark, [{"seller_id": 1, "margin": 0.5}]))
    assert [(r["seller_id"], r["carrier"], float(r["total"])) for r in extra.collect()] == [
        (1, "dhl", 174.0)]
    totals = by_seller(receivables.statement_totals(charge, rows, extra))
    assert (float(totals[1]["total"]), float(totals[2]["total"])) == (290, 11.6)


def test_config_merge_and_repricing(spark):
    stored = b.config(spark, [
        {"seller_id": 1, "client": "A", "method": "flat", "margin": 0.1, "credit_days": 15, "note": "x"},
        {"seller_id": 2, "client": "B", "method": "flat", "margin": 0.1},
    ])
    changes = spark.createDataFrame(
        [(1, None, "", None, False, None, True),
         (3, "C", "margin_global", Decimal("0.2"), True, 45, True)],
        "seller_id long, client string, method string, margin decimal(9,6), margin_sent boolean, "
        "credit_days int, credit_days_sent boolean",
    )
    after = receivables.update_credit_config(stored, changes)
    found = by_seller(after)
    one, two, three = found[1], found[2], found[3]
    assert (one["client"], one["method"], float(one["margin"])) == ("A", "flat", 0.1)
    assert one["credit_days"] is None and one["note"] is None and two["client"] == "B"
    assert (three["method"], three["credit_days"]) == ("margin_global", 45)
    assert [r["seller_id"] for r in receivables.config_changed(stored, after).collect()] == [3]


def test_detail_keeps_the_largest_lines_per_charge(spark):
    waybills = [f"W{i}" for i in range(6)]
    rows = recon(spark, [
        {"waybill": w, "seller_id": 1, "income": i} for i, w in enumerate(waybills)
    ])
    charge = b.charges(spark, [{"seller_id": 1, "month": MONTH, "concept": "invoice"}])
    lines = b.invoices(spark, [b.line(w, 1) for w in waybills])
    detail = receivables.charge_detail(charge, rows, lines, limit=2).orderBy("position").collect()
    assert [r["waybill"] for r in detail] == ["W5", "W4"]


def test_month_close_and_reopen(spark):
    rows = recon(spark, [{"waybill": "a", "cost": 10, "income": 15}, {"waybill": "b", "income": 4}])
    closed = reports.close_month(rows, b.frame(spark, schemas.PERIODS, []), MONTH, NOW)
    again = reports.close_month(rows, closed, MONTH, NOW)
    row = again.collect()
    assert len(row) == 1
    assert [float(row[0][c]) for c in ("cost", "income", "profit")] == [10, 19, 5]
    assert reports.reopen_month(again, again).count() == 0
    k = reports.kpis(rows).first()
    assert [float(k[c]) for c in ("income", "margin", "to_accrue")] == [15, 5, 4]
