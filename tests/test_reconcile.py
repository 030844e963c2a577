"""Billing rules on known cases, and behaviour under skew."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import builders as b
from cargoledger import schemas
from cargoledger.operators import pricing, reconcile

PREPAID, CREDIT = "Prepago", "Prepago sin saldo"


def book(spark, **tables):
    names = ("cost_rates", "fuel_rates", "zone_margins", "kilo_margins", "flat_rates")
    return pricing.price_book(*[tables.get(n) or getattr(b, n)(spark) for n in names])


MARKUP, VAT = 1.14, 1.16
#: name -> (cost, seller, seller name, payment model, sale price, overweight) of a plain shipment
PLAIN = {
    "paid in full": (240, 21, "Birch", PREPAID, 300, 0),
    "paid short": (500, 22, "Cedar", PREPAID, 410, 25),
    "own account": (75, 23, "se00724", PREPAID, 0, 0),
    "credit sold": (90, 24, "Dogwood", CREDIT, 95, 0),
    "no model": (60, 25, "Elm", "", 61, 0),
}


@pytest.fixture(scope="module")
def billed(spark):
    lines = [b.line(name, cost) for name, (cost, *_) in PLAIN.items()]
    lines += [
        b.line("card price", 70, kilos=12, zone="6"), b.line("card gap", 70, kilos=40, zone="6"),
        b.line("stranger", 33), b.line("came back", 44, is_return=True, reference="RT7770001234"),
    ]
    known = [b.shipment(name, s, who, model, sale) for name, (_, s, who, model, sale, _) in PLAIN.items()]
    known += [b.shipment(w, 26, "Fir", CREDIT, 1) for w in ("card price", "card gap")]
    known.append(b.shipment("7770001234", 27, "Gum", PREPAID, 88))
    card = [{"seller_id": 26, "carrier": "dhl", "zone": "6", "kilo_min": 10, "kilo_max": 20, "price": 305}]
    heavy = [{"waybill": name, "amount": w} for name, (*_, w) in PLAIN.items() if w]
    result = reconcile.reconcile(
        b.invoices(spark, lines), b.shipments(spark, known), b.overweight(spark, heavy),
        b.surcharges(spark), b.config(spark, [{"seller_id": 26, "client": "Fir", "method": "manual"}]),
        book(spark, flat_rates=b.flat_rates(spark, card)),
    )
    schemas.check_schema(result, schemas.RECONCILIATION)
    return {r["waybill"]: r for r in result.collect()}


@pytest.mark.parametrize("name", ["paid in full", "paid short", "credit sold", "no model"])
def test_floor_is_cost_and_markup(billed, name):
    """What was billed stands, unless it stays below cost with the usual markup."""
    cost, _, _, _, sale, heavy = PLAIN[name]
    due = max(0, cost * MARKUP - sale - heavy)
    row = billed[name]
    assert float(row["extra"]) == pytest.approx(due)
    assert float(row["income"]) == pytest.approx(sale + heavy + due)
    assert row["status"] == ("extra_due" if due > 0.5 else "billed_ok")


def test_own_accounts_pay_cost_and_agreed_margin(billed):
    row = billed["own account"]
    assert row["status"] == "internal"
    assert float(row["margin"]) == pytest.approx(PLAIN["own account"][0] * (MARKUP - 1))


def test_flat_card_prices_inside_its_band_only(billed):
    assert float(billed["card price"]["income"]) == pytest.approx(305 * VAT)
    assert billed["card price"]["status"] == "billed_ok"
    assert billed["card gap"]["income"] is None and billed["card gap"]["status"] == "credit_unbilled"


def test_unknown_waybill_keeps_its_sender(billed):
    row = billed["stranger"]
    assert (row["status"], row["income"], row["client"]) == ("not_in_system", None, "rem")


def test_return_is_charged_to_the_client_of_its_original(billed):
    back, original = billed["came back"], billed["7770001234"]
    assert (back["client"], back["status"]) == ("Gum", "extra_due")
    assert float(back["extra"]) == pytest.approx(44 * MARKUP)
    assert not original["has_cost"] and original["status"] == "billed_cost_pending"
    assert float(original["income"]) == 88


def test_one_row_per_waybill(billed):
    assert len(billed) == len(PLAIN) + 5


def run(spark, lines, known, config=(), **extra):
    result = reconcile.reconcile(
        b.invoices(spark, lines), b.shipments(spark, known), b.overweight(spark),
        b.surcharges(spark, extra.pop("surcharges", ())), b.config(spark, config), book(spark, **extra),
    )
    return {r["waybill"]: r for r in result.collect()}


def test_dedup_puts_undated_lines_last(spark):
    rows = b.invoices(spark, [
        b.line("W", 10, invoice_date=None), b.line("W", 30, invoice_date=dt.date(2026, 6, 2)),
        b.line("W", 20, invoice_date=dt.date(2026, 6, 1), carrier="fedex"),
        b.line("V", 7, invoice_date=None),
    ])
    kept = {r["waybill"]: float(r["net_amount"]) for r in reconcile.dedup_invoices(rows).collect()}
    assert kept == {"W": 20.0, "V": 7.0}


def test_extra_at_the_tolerance_is_not_due(spark):
    known = [b.shipment("AT", 1, "A", PREPAID, 113.5), b.shipment("OVER", 1, "A", PREPAID, 113.49)]
    rows = run(spark, [b.line("AT", 100), b.line("OVER", 100)], known)
    assert rows["AT"]["status"] == "billed_ok" and float(rows["AT"]["extra"]) == 0.5
    assert rows["OVER"]["status"] == "extra_due"


def test_internal_fragment_in_any_case(spark):
    known = [b.shipment("I", 1, "Grupo inBursa Centro", PREPAID, 0), b.shipment("S", 2, "se00724", "", 0)]
    rows = run(spark, [b.line("I", 100), b.line("S", 50)], known)
    assert rows["I"]["account_type"] == "internal" and float(rows["I"]["income"]) == 114
    assert rows["S"]["account_type"] == "internal" and float(rows["S"]["income"]) == 57


def test_return_of_unknown_original(spark):
    rows = run(spark, [b.line("R", 50, is_return=True, reference="rt0000000001")], [])
    assert rows["R"]["status"] == "not_in_system" and rows["R"]["seller_id"] is None


def test_return_without_digits_matches_no_empty_waybill(spark):
    lines = [b.line("R", 50, is_return=True, reference="RT")]
    rows = run(spark, lines, [b.shipment("", 1, "Empty", PREPAID, 1)])
    assert rows["R"]["status"] == "not_in_system"


def test_surcharge_price_uses_margin_and_vat(spark):
    rows = run(
        spark, [b.line("W", 100, zone="1")], [b.shipment("W", 5, "C", CREDIT, 0)],
        [{"seller_id": 5, "method": "flat", "margin": 0.2}],
        surcharges=[
            {"carrier": "dhl", "waybill": "W", "concept": "a", "amount": 10},
            {"carrier": "fedex", "waybill": "W", "concept": "b", "amount": 5},
        ],
        flat_rates=b.flat_rates(
            spark, [{"seller_id": 5, "carrier": "dhl", "zone": "1", "price": 100}]
        ),
    )
    assert float(rows["W"]["surcharges"]) == 20.88
    assert float(rows["W"]["income"]) == 136.88


def test_missing_ship_date_falls_back_to_creation(spark):
    rows = run(spark, [b.line("W", 1, ship_date=None)], [b.shipment("W", 1, "A", PREPAID, 1)])
    assert rows["W"]["ship_month"] == "2026-05" and rows["W"]["invoice_month"] == "2026-05"


def test_one_waybill_and_one_seller_with_a_third_of_all_rows(spark):
    """Hot keys: results stay whole and equal those of the same rows without repeats."""
    n = 9_000
    ids = spark.range(n)
    waybill = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.format_string("W%07d", "id"))
    base = b.invoices(spark, [b.line("X", 100)]).drop("waybill", "net_amount")
    lines = base.crossJoin(
        ids.select(waybill.alias("waybill"), (F.col("id") + 1).cast("decimal(18,6)").alias("net_amount"))
    ).select(schemas.CARRIER_INVOICES.names)
    names = lines.select("waybill").distinct()
    known = schemas.conform(
        names.select(
            "waybill", F.lit(7).alias("seller_id"), F.lit("Hot seller").alias("seller_name"),
            F.lit(PREPAID).alias("payment_model"), F.lit(0).alias("sale_price"),
            F.lit(b.CREATED).alias("created_at"),
        ),
        schemas.SHIPMENTS,
    )
    result = reconcile.reconcile(
        schemas.conform(lines, schemas.CARRIER_INVOICES), known, b.overweight(spark),
        b.surcharges(spark), b.config(spark), book(spark),
    )
    totals = result.agg(
        F.count("*").alias("n"), F.countDistinct("waybill").alias("d"),
        F.sum("cost").alias("cost"),
        F.max(F.when(F.col("waybill") == "HOT", F.col("cost"))).alias("hot"),
    ).first()
    kept = [i + 1 for i in range(n) if i % 3]
    assert (totals["n"], totals["d"]) == (len(kept) + 1, len(kept) + 1)
    assert float(totals["hot"]) == 1.0 and float(totals["cost"]) == sum(kept) + 1


def test_first_lines_part_by_part_equal_those_of_all(spark, tmp_path):
    rng = random.Random(9)
    rows = [
        b.line(rng.choice([None, *(f"W{k}" for k in range(30))]), rng.randrange(3), carrier=rng.choice(["dhl", "fedex", "x"]),
               invoice_date=rng.choice([None, b.INVOICED, b.SHIP]), kilos=rng.randrange(3), sender=rng.choice([None, "a", "b"]))
        for _ in range(300)
    ]
    lines = b.invoices(spark, rows)
    parts = [lines.filter(F.col("carrier") == c) for c in ("dhl", "fedex", "x")]
    got = reconcile.dedup_parts(parts, f"{tmp_path}/lines")
    want = reconcile.dedup_invoices(lines)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    assert [p.name for p in (tmp_path / "lines").iterdir()] == ["2"]  # lines that others replaced are gone


def test_returns_are_resolved_by_first_lines_alone(spark):
    """A later line of a return names another original; the shipment of the first line's original owns it, either way."""
    lines = b.invoices(spark, [
        b.line("back", 5, is_return=True, reference="RT0000000001", invoice_date=b.SHIP),
        b.line("back", 5, is_return=True, reference="RT0000000002"), b.line("0000000001", 7),
    ])
    known = b.shipments(spark, [b.shipment(f"000000000{k}", k, f"S{k}", PREPAID, 9) for k in (1, 2)])
    every = reconcile.attribute(lines, known, b.overweight(spark), b.surcharges(spark)).collect()
    first = reconcile.attribute(reconcile.dedup_invoices(lines), known, b.overweight(spark), b.surcharges(spark)).collect()
    assert sorted(map(repr, every)) == sorted(map(repr, first))
    assert {r["waybill"]: r["seller_id"] for r in first}["back"] == 1
