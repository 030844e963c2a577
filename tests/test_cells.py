"""Compiled cells against a brute-force reading of the rate rows, and the plan of a price."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import builders as b
from cargoledger.operators import cells, pricing

D = dt.date
RATE = "carrier string, zone string, service string, kilo_min double, kilo_max double, valid_from date, valid_to date, cost decimal(18,6)"


def rate_row(rng, carrier, width):
    start, day = rng.randrange(width), D(2020, 1, 1) + dt.timedelta(rng.randrange(900))
    return (
        carrier, rng.choice("12"), rng.choice([None, "", "N", "G"]),
        rng.choice([None, float(start), start + 0.5]), rng.choice([None, float(start + rng.randrange(1, 40))]),
        rng.choice([None, day]), rng.choice([None, day + dt.timedelta(rng.randrange(400))]), Decimal(rng.randrange(1, 500)),
    )


def best(rates, carrier, zone, service, kilo, day):
    held = [
        r for r in rates
        if r[0] == carrier and r[1] == zone and (r[2] or "") in ("", service or "")
        and (r[3] is None or r[3] <= kilo) and (r[4] is None or kilo < r[4])
        and (r[5] or D(1900, 1, 1)) <= day <= (r[6] or D(2999, 1, 1))
    ]
    order = lambda r: ((r[2] or "") != (service or ""), r[3] is None, r[3] or 0, r[7])
    return float(min(held, key=order)[7]) if held else None


@pytest.mark.parametrize("chunk", [8, 256])
def test_hot_key_is_swept_in_chunks_and_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cells, "CHUNK", chunk)
    rng = random.Random(4)
    rates = [rate_row(rng, "dhl", 90) for _ in range(160)] + [rate_row(rng, "fedex", 90) for _ in range(40)]
    card = pricing.cost_card(spark.createDataFrame(rates, RATE))
    probes = [
        (i, rng.choice(["dhl", "fedex"]), rng.choice("12"), rng.choice([None, "N", "G", "Z"]),
         rng.choice([0.0, 0.5, float(rng.randrange(130))]), D(2019, 6, 1) + dt.timedelta(rng.randrange(1600)))
        for i in range(400)
    ]
    rows = spark.createDataFrame(probes, "i int, carrier string, zone string, service string, kilos double, ship_date date")
    book = pricing.PriceBook(card, *[card] * 6)
    found = pricing.lookup_cost(rows, book).collect()
    assert len(found) == len(probes)
    got = {r["i"]: r["unit_cost"] and float(r["unit_cost"]) for r in found}
    assert got == {p[0]: best(rates, *p[1:]) for p in probes}


def test_chunks_of_a_hot_key_are_many_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 16)
    rows = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id)) as key", "cast(id as double) as low_kilo", "cast(id + 2 as double) as high_kilo",
        "'best' as layer", "0 as best",
    )
    dealt = cells._chunked(rows, ["key"], ["kilo"]).filter("key = 'hot'")
    sizes = [r["n"] for r in dealt.groupBy("chunk_kilo").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 40 and max(sizes) <= 4 * 1000 / 40
    assert cells._chunked(rows, ["key"], ["kilo"]).filter("key <> 'hot'").count() == 2000


def test_keys_of_few_rows_get_no_quantiles(spark, monkeypatch):
    rows = spark.range(3000).selectExpr(
        "id % 1000 as key", "cast(id as double) as low_kilo", "cast(id + 2 as double) as high_kilo", "'best' as layer", "0 as best",
    )

    def shown():
        dealt = cells._chunked(rows, ["key"], ["kilo"])
        found = dealt.collect()
        final = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return len(found), "percentile_approx" in final

    assert shown() == (3000, False)
    monkeypatch.setattr(cells, "CHUNK", 2)
    assert shown()[1]


def test_a_row_alone_is_its_own_cell(spark):
    """Keys of one row, a row alone on the inner axis, a row of one layer alone."""
    names = "key string, low_kilo double, high_kilo double, low_day int, high_day int, rank array<double>, value decimal(30,10)"
    cost = [("a", 0.0, 5.0, 1, 9, [1.0], Decimal(7)), ("b", 0.0, 5.0, 1, 9, [1.0], Decimal(3)), ("b", 4.0, 8.0, 2, 3, [0.0], None)]
    fuel = [("b", 20.0, 30.0, 1, 9, [1.0], Decimal(1)), ("c", 0.0, 1.0, 0, 1, [2.0], Decimal(4))]
    layers = {"cost": spark.createDataFrame(cost, names), "fuel": spark.createDataFrame(fuel, names)}
    found = cells.compile_cells(layers, ["key"], ["kilo", "day"])
    got = {
        (r["key"], r["kilo_low"], r["kilo_high"], r["day_low"], r["day_high"]): tuple(r[x] and (r[x]["none"], r[x]["value"]) for x in layers)
        for r in found.collect()
    }
    seven, three, one, four = ((False, Decimal(n)) for n in (7, 3, 1, 4))
    assert got == {
        ("a", 0, 5, 1, 9): (seven, None), ("b", 0, 4, 1, 9): (three, None), ("b", 4, 5, 1, 2): (three, None),
        ("b", 4, 5, 2, 3): ((True, None), None), ("b", 4, 5, 3, 9): (three, None), ("b", 5, 8, 2, 3): ((True, None), None),
        ("b", 20, 30, 1, 9): (None, one), ("c", 0, 1, 0, 1): (None, four),
    }


def test_layers_meet_in_one_cell(spark):
    rates = [{"carrier": "dhl", "zone": "1", "cost": 100, "kilo_max": 10}, {"carrier": "dhl", "zone": "1", "service": "G", "cost": 80}]
    fuel = [{"carrier": "dhl", "pct": 0.1, "valid_from": D(2026, 1, 1)}, {"carrier": "dhl", "pct": 0.3, "service": "N"}]
    card = pricing.tariff_card(b.cost_rates(spark, rates), b.fuel_rates(spark, fuel))
    day = F.lit(D(2026, 2, 1))
    at = card.filter((F.col("day_low") <= day) & (F.col("day_high") > day) & (F.col("kilo_low") <= 5) & (F.col("kilo_high") > 5))
    got = {r["service"]: (float(r["cost"]), r["fuel"] and float(r["fuel"])) for r in at.collect()}
    assert got == {"G": (80, 0.1), "N": (100, 0.3), "": (100, 0.1)}
    early = card.filter((F.col("service") == "G") & (F.col("day_low") == D(1900, 1, 1))).collect()
    assert early and all(r["fuel"] is None for r in early)
    assert {r["service"]: r["known"] for r in card.collect()}[""] == ["G", "N"]


@pytest.fixture(scope="module")
def priced_case(spark, tmp_path_factory):
    rng = random.Random(9)
    sellers = {i: ["automatic", "flat", "margin_global", "margin_zone", "margin_kilo", None][i % 6] for i in range(12)}
    cost = [dict(zip(("carrier", "zone", "service", "kilo_min", "kilo_max", "valid_from", "valid_to", "cost"), rate_row(rng, "dhl", 30), strict=True)) for _ in range(60)]
    fuel = [{"carrier": "dhl", "service": rng.choice([None, "G"]), "pct": rng.randrange(30) / 100, "valid_from": rng.choice([None, D(2020, rng.randrange(1, 13), 1)])} for _ in range(12)]
    zone = [{"seller_id": i, "zone": z, "margin": rng.randrange(40) / 100} for i in sellers for z in "12" if rng.random() < 0.7]
    kilo = [{"seller_id": i, "kilo_min": lo, "kilo_max": lo and lo + 15, "margin": rng.randrange(40) / 100} for i in sellers for lo in (None, 5.0, 10.0)]
    flat = [{"seller_id": i, "carrier": "dhl", "zone": z, "kilo_min": lo, "price": rng.randrange(1, 90)} for i in sellers for z in "12" for lo in (None, 8.0)]
    book = pricing.price_book(b.cost_rates(spark, cost), b.fuel_rates(spark, fuel), b.zone_margins(spark, zone), b.kilo_margins(spark, kilo), b.flat_rates(spark, flat))
    book = pricing.store_price_book(book, str(tmp_path_factory.mktemp("book")))
    rows = []
    for i in range(500):
        seller = rng.choice([None, *sellers])
        rows.append((
            i, rng.choice(["dhl", "ups", None]), rng.choice(["1", "2", None]), rng.choice([None, "N", "G"]), rng.choice([None, *map(float, range(30))]),
            rng.choice([None, D(2020, 1, 1) + dt.timedelta(rng.randrange(900))]), seller, sellers.get(seller), rng.choice([None, "0.25"]),
        ))
    names = "i int, carrier string, zone string, service string, kilos double, ship_date date, seller_id long, method string, margin string"
    frame = spark.createDataFrame(rows, names).selectExpr("*", "cast(margin as decimal(9,6)) as client_margin")
    return book, frame


def by_single_lookups(book, rows):
    """The price put together from one lookup at a time."""
    df = pricing.lookup_cost(rows, book, "c")
    df = pricing.lookup_fuel(df, book, "f")
    df = pricing.lookup_zone_margin(df, book, "z")
    df = pricing.lookup_kilo_margin(df, book, "k")
    return {r["i"]: r for r in pricing.lookup_flat(df, book, "p").collect()}


def test_price_in_two_probes_equals_single_lookups(priced_case):
    book, rows = priced_case
    parts = by_single_lookups(book, rows)
    found = pricing.price(rows, book, fuel="fuel").collect()
    assert len(found) == len(parts) == 500
    seen = set()
    for r in found:
        p, method = parts[r["i"]], r["method"]
        margin = {"margin_global": r["client_margin"] or 0, "margin_zone": p["z"], "margin_kilo": p["k"]}.get(method)
        if method == "flat":
            want = p["p"] and float(p["p"]) * 1.16
        else:
            want = None if margin is None or p["c"] is None else float(p["c"]) * (1 + float(p["f"])) * (1 + float(margin)) * 1.16
        seen.add((method, want is None))
        assert (r["tariff_price"] is None) == (want is None)
        assert want is None or abs(float(r["tariff_price"]) - want) < 1e-6
        if want is not None and method != "flat":
            assert r["fuel"] == p["f"]
    assert {m for m, none in seen if not none} == {"flat", "margin_global", "margin_zone", "margin_kilo"}


def test_price_is_two_joins_with_keys_that_are_never_null(spark, priced_case):
    book, rows = priced_case
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        priced = pricing.price(rows, book)
        plan = priced._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.splitlines() if "Join" in x]
        assert len(lines) == 2 and all("SortMergeJoin" in x for x in lines)
        # spread is a key of both, so rows without a probe do not meet in one task
        assert plan.count("_cell_spread") >= 2
        assert sum("Exchange hashpartitioning" in x and "_cell_spread" in x for x in plan.splitlines()) == 2
        assert priced.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
