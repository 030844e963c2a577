"""Rate lookups against a brute-force reading of the same rules."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import builders as b
from cargoledger.operators import pricing, tariffs

D = dt.date


def test_kilo_band_is_half_open(spark):
    df = spark.createDataFrame([(4.99,), (5.0,), (9.99,), (10.0,)], "kilo double")
    inside = df.filter(pricing.kilo_band(F.col("kilo"), F.lit(5.0), F.lit(10.0)))
    assert [r["kilo"] for r in inside.collect()] == [5.0, 9.99]


def test_validity_includes_both_ends_and_open_bounds(spark):
    days = [D(2026, 1, 1), D(2026, 1, 31), D(2025, 12, 31), D(2026, 2, 1)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    window = pricing.validity_window(F.col("day"), F.lit(days[0]), F.lit(days[1]))
    assert df.filter(window).count() == 2
    open_ended = pricing.validity_window(F.col("day"), F.lit(None).cast("date"), F.lit(None).cast("date"))
    assert df.filter(open_ended).count() == 4


def _holds(rate, row):
    return (
        rate["carrier"] == row["carrier"] and rate["zone"] == row["zone"]
        and (rate["kilo_min"] is None or row["kilos"] >= rate["kilo_min"])
        and (rate["kilo_max"] is None or row["kilos"] < rate["kilo_max"])
        and (rate["valid_from"] or D(1900, 1, 1)) <= row["ship_date"]
        <= (rate["valid_to"] or D(2999, 1, 1))
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cost_lookup_equals_brute_force_on_overlapping_rates(spark, seed):
    rng = random.Random(seed)
    edges = [None, 0, 2, 5, 5.5, 10, 20]
    days = [None, D(2025, 1, 1), D(2025, 6, 30), D(2025, 7, 1), D(2026, 1, 1)]
    rates = [
        {
            "carrier": rng.choice(["dhl", "fedex"]), "zone": rng.choice("12"),
            "kilo_min": rng.choice(edges), "kilo_max": rng.choice(edges),
            "valid_from": rng.choice(days), "valid_to": rng.choice(days),
            "service": rng.choice([None, "", "N", "G"]), "cost": rng.randint(1, 99),
        }
        for _ in range(80)
    ]
    rows = [
        {
            "waybill": f"W{i}", "carrier": rng.choice(["dhl", "fedex"]), "zone": rng.choice("12"),
            "kilos": rng.choice([0, 1.9, 2, 5, 5.4, 5.5, 9.9, 10, 25]),
            "ship_date": rng.choice([D(2024, 1, 1), *days[1:], D(2027, 3, 3)]),
            "service": rng.choice([None, "", "N", "G", "Z"]), "net_amount": 1,
        }
        for i in range(150)
    ]
    expected = {}
    for row in rows:
        service = row["service"] or ""
        matches = [r for r in rates if _holds(r, row) and (r["service"] or "") in ("", service)]
        best = min(
            matches, default=None,
            key=lambda r: (
                (r["service"] or "") != service, r["kilo_min"] is None, r["kilo_min"] or 0, r["cost"]
            ),
        )
        expected[row["waybill"]] = best and float(best["cost"])
    book = pricing.price_book(
        b.cost_rates(spark, rates), b.fuel_rates(spark), b.zone_margins(spark),
        b.kilo_margins(spark), b.flat_rates(spark),
    )
    found = pricing.lookup_cost(b.invoices(spark, rows), book).collect()
    assert len(found) == len(rows)
    assert {r["waybill"]: r["unit_cost"] and float(r["unit_cost"]) for r in found} == expected


def test_compiled_cells_do_not_overlap(spark):
    rates = [
        {"carrier": "dhl", "zone": "1", "kilo_min": lo, "kilo_max": hi, "cost": c}
        for lo, hi, c in ((None, 10, 5), (2, 6, 7), (4, None, 1), (4, 8, 9))
    ]
    cells = pricing.cost_card(b.cost_rates(spark, rates)).orderBy("kilo_low").collect()
    bounds = [(r["kilo_low"], r["kilo_high"], float(r["value"])) for r in cells]
    assert bounds == [
        (-1e12, 2.0, 5.0), (2.0, 4.0, 7.0), (4.0, 6.0, 7.0), (6.0, 8.0, 1.0), (8.0, 10.0, 1.0),
        (10.0, 1e12, 1.0),
    ]


def test_fuel_prefers_the_service_then_the_newest(spark):
    fuel = [
        {"carrier": "dhl", "pct": 0.10}, {"carrier": "dhl", "pct": 0.11, "valid_from": D(2026, 1, 1)},
        {"carrier": "dhl", "pct": 0.12, "valid_from": D(2026, 4, 1)},
        {"carrier": "dhl", "pct": 0.20, "valid_from": D(2025, 1, 1), "service": "G"},
    ]
    book = pricing.price_book(
        b.cost_rates(spark), b.fuel_rates(spark, fuel), b.zone_margins(spark),
        b.kilo_margins(spark), b.flat_rates(spark),
    )
    rows = [
        b.line("own", 1, service="G"), b.line("general", 1), b.line("none", 1, carrier="fedex"),
        b.line("old", 1, ship_date=D(2025, 12, 31)),
    ]
    found = pricing.lookup_fuel(b.invoices(spark, rows), book).collect()
    assert {r["waybill"]: float(r["fuel"]) for r in found} == {
        "own": 0.20, "general": 0.12, "none": 0.0, "old": 0.10,
    }


@pytest.mark.parametrize(
    ("method", "price"),
    [("automatic", None), ("flat", 116.0), ("margin_global", 191.4), ("margin_zone", 146.74),
     ("margin_kilo", 165.88)],
)
def test_price_by_method(spark, method, price):
    book = pricing.price_book(
        b.cost_rates(spark, [{"carrier": "dhl", "zone": "1", "cost": 100}]),
        b.fuel_rates(spark, [{"carrier": "dhl", "pct": 0.10}]),
        b.zone_margins(spark, [{"seller_id": 1, "zone": "1", "margin": 0.15}]),
        b.kilo_margins(spark, [{"seller_id": 1, "kilo_max": 5, "margin": 0.3}]),
        b.flat_rates(spark, [{"seller_id": 1, "carrier": "dhl", "zone": "1", "price": 100}]),
    )
    rows = b.invoices(spark, [b.line("W", 1, zone="1")]).selectExpr(
        "*", "1L as seller_id", f"'{method}' as method", "cast(0.5 as decimal(9,6)) as client_margin"
    )
    found = pricing.price(rows, book).first()["tariff_price"]
    assert (found and float(found)) == price


def test_empty_own_cost_hides_the_general_one(spark):
    rates = [
        {"carrier": "dhl", "zone": "1", "cost": 9},
        {"carrier": "dhl", "zone": "1", "service": "N", "cost": None},
    ]
    book = pricing.price_book(
        b.cost_rates(spark, rates), b.fuel_rates(spark), b.zone_margins(spark),
        b.kilo_margins(spark), b.flat_rates(spark),
    )
    assert pricing.lookup_cost(b.invoices(spark, [b.line("W", 1, zone="1")]), book).first()["unit_cost"] is None


def test_stored_book_is_broadcast_without_hints_and_shuffled_when_large(spark, tmp_path):
    rates = [{"carrier": "dhl", "zone": "1", "cost": 9}]
    book = pricing.store_price_book(
        pricing.price_book(
            b.cost_rates(spark, rates), b.fuel_rates(spark), b.zone_margins(spark),
            b.kilo_margins(spark), b.flat_rates(spark),
        ),
        str(tmp_path),
    )
    rows = b.invoices(spark, [b.line("W", 1, zone="1")])
    plan = lambda: pricing.lookup_cost(rows, book)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" in plan() and "NestedLoop" not in plan()
        assert float(pricing.lookup_cost(rows, book).first()["unit_cost"]) == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matrix_orders_zones_and_labels_bands(spark):
    rows = spark.createDataFrame(
        [(1, "dhl", "G", z, lo, hi, 1.0) for z in ("10", "2", "A")
         for lo, hi in ((None, 5.0), (5.0, 6.0), (6.0, None))],
        "seller_id long, carrier string, service string, zone string, kilo_min double, "
        "kilo_max double, price double",
    )
    matrix = tariffs.tariff_matrix(rows)
    assert [c for c in matrix.columns if c.startswith("zone_")] == ["zone_2", "zone_10", "zone_A"]
    assert {r["band"] for r in matrix.collect()} == {"0 a 5.0", "5 kg", "6.0 a ∞"}
    assert matrix.first()["service_name"] == "ECONOMY SELECT DOMESTIC"


def test_a_band_is_priced_once_whatever_its_rate_rows(spark, monkeypatch):
    rates = [
        {"carrier": "dhl", "zone": z, "kilo_max": 5, "service": s, "cost": c}
        for z in ("1", None) for s in (None, "", "N") for c in (7, 7, 9, None)
    ]
    rates += [{"carrier": "dhl", "zone": "1", "kilo_max": 5, "cost": 1, "valid_to": D(2020, 1, 1)}]
    card = b.cost_rates(spark, rates)
    book = pricing.price_book(
        card, b.fuel_rates(spark), b.zone_margins(spark), b.kilo_margins(spark), b.flat_rates(spark)
    )
    clients = spark.createDataFrame(
        [(1, "dhl", "a", "margin_global", 0.5), (2, "dhl", "b", "margin_global", None), (3, "dhl", "c", "flat", 0.1)],
        "seller_id long, carrier string, client string, method string, margin double",
    ).withColumn("margin", F.col("margin").cast("decimal(9,6)"))
    probed = []

    def counted(df, *args, **more):
        probed.append(df)
        return pricing.price(df, *args, **more)

    monkeypatch.setattr(tariffs, "price", counted)
    listed = tariffs.tariff_preview(clients, card, book, D(2024, 1, 1))
    assert probed[0].count() == 2 * 6  # clients times bands, not times the 24 rate rows
    assert probed[0].rdd.getNumPartitions() > 1
    shown = sorted(map(repr, listed.collect()))
    assert len(shown) == 2 * 24
    costs = sorted(str(r["cost"]) for r in listed.filter("seller_id = 1 and zone is null and service = 'N'").collect())
    assert costs == ["7.000000", "7.000000", "9.000000", "None"]
    bands = tariffs.priced_bands(clients, card, book, D(2024, 1, 1))
    assert sorted(map(repr, tariffs.listed_rates(bands, card, D(2024, 1, 1)).collect())) == shown
    assert bands.agg(F.sum("rates")).first()[0] == 48
    anew = tariffs.reprice(bands, clients.filter("seller_id = 2"), card, book, D(2024, 1, 1))
    assert sorted(map(repr, tariffs.listed_rates(anew, card, D(2024, 1, 1)).collect())) == shown
    made = [tariffs.generated_tariffs(x, clients, D(2024, 1, 1), "2024-01-01 00:00:00") for x in (bands, listed)]
    assert sorted(r["bytes"] for r in made[0].collect()) == sorted(r["bytes"] for r in made[1].collect()) == [24, 24]
