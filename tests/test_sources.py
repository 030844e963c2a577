"""Carrier files, mirror roll-ups and table maintenance."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import builders as b
from cargoledger import schemas
from cargoledger.functions import cleaners
from cargoledger.sources import carriers, mirror, surcharges, tables

SENT, BILLED = dt.datetime(2025, 3, 9, 7, 30), dt.datetime(2025, 4, 1)


def _typed_lines(spark):
    """A typed table as a spreadsheet reader yields it: numbers, times, and an empty last row."""
    cells = {
        "Zona": ["4", None, None], "Remitente": ["Tea House", "Lamp Works", None],
        "No.De Guia": [5550001112, 5550003334, None], "Importe Neto": [47.25, 310.0, None],
        "OO": [0.75, 12.5, None], "FF": [0.0, 4.25, None], "Producto": [" G", "N  ", None],
        "Referencia": ["rt5550001112", "order 81", None], "Pza": [3, 12, None],
        "Fecha Envio": [SENT, None, None], "Fecha Factura": [None, BILLED, None],
    }
    kinds = {
        "No.De Guia": "bigint", "Importe Neto": "double", "OO": "double", "FF": "double", "Pza": "int",
        "Fecha Envio": "timestamp", "Fecha Factura": "timestamp",
    }
    schema = ", ".join(f"`{name}` {kinds.get(name, 'string')}" for name in cells)
    return spark.createDataFrame(list(zip(*cells.values(), strict=True)), schema)


def test_typed_table(spark):
    lines = carriers.normalise_invoices(_typed_lines(spark), "dhl", "march")
    schemas.check_schema(lines, schemas.CARRIER_INVOICES)
    rows = {r["waybill"]: r for r in lines.collect()}
    assert set(rows) == {"5550001112", "5550003334"}
    back, sale = rows["5550001112"], rows["5550003334"]
    assert back["is_return"] and not sale["is_return"]
    assert (back["service"], sale["service"], back["zone"], sale["zone"]) == ("G", "N", "4", None)
    assert (float(back["surcharges"]), float(sale["surcharges"])) == (0.75, 12.5 + 4.25)
    assert (back["ship_date"], back["invoice_date"]) == (SENT.date(), None)
    assert (sale["ship_date"], sale["invoice_date"]) == (None, BILLED.date())
    assert back["sender"] == "Tea House" and sale["pieces"] == 12 and sale["source_file"] == "march"


def test_texts_that_nobody_reads_are_not_cleaned(spark):
    lines = carriers.normalise_invoices(_typed_lines(spark), "dhl", "march")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    slim = plan(lines.select("waybill", "net_amount"))
    assert "Remitente" not in slim and "Producto" not in slim and "Importe Neto" in slim
    assert "Remitente" in plan(lines.select("sender"))
    # the texts read are those of the whole line
    for name in ("waybill", "reference", "service", "sender", "zone", "currency", "account", "is_return"):
        assert lines.select(name).collect() == [(r[name],) for r in lines.collect()]


def test_an_amount_too_large_is_an_error_whichever_is_read(spark):
    raw = _typed_lines(spark).withColumn("Flete", F.lit("1" + "0" * 12))
    with pytest.raises(Exception, match="amount too large"):
        carriers.normalise_invoices(raw, "dhl", "march").select("waybill", "net_amount").collect()


def test_every_file_is_bound_by_its_own_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text("No.De Guia,Importe Neto,Zona,Pza\nW1,100,3,1\n")
    (tmp_path / "two.csv").write_text("Zona,Extra,No.De Guia,Importe Neto\n5,x,W2,200\n")
    (tmp_path / "three of them.csv").write_text("Importe Neto,No.De Guia\n300,W3\n400,W4\n")
    (tmp_path / "four.csv").write_text("Zona,Extra,No.De Guia,Importe Neto\n6,y,W5,500\n")
    rows = carriers.read_invoices(spark, f"{tmp_path}/*.csv", "dhl").collect()
    found = {r["waybill"]: (float(r["net_amount"]), r["zone"], r["pieces"]) for r in rows}
    assert found == {
        "W1": (100, "3", 1), "W2": (200, "5", None), "W3": (300, None, None), "W4": (400, None, None),
        "W5": (500, "6", None),
    }
    assert {r["source_file"].replace("%20", " ") for r in rows if r["waybill"] == "W3"} == {"three of them.csv"}
    (tmp_path / "five.csv").write_text("Guide,Importe Neto\nW9,1\n")
    with pytest.raises(ValueError, match="No.De Guia"):
        carriers.read_invoices(spark, f"{tmp_path}/*.csv", "dhl")


@pytest.mark.parametrize(
    ("text", "day"),
    [("2024-01-02T03:04:05.000Z", dt.date(2024, 1, 2)), ("2024-01-02T03:04:05+01:00", dt.date(2024, 1, 2)),
     ("2024-01-02 03:04:05.123456", dt.date(2024, 1, 2)), ("2024-1-2", dt.date(2024, 1, 2)),
     ("2024-01-02T03:04", dt.date(2024, 1, 2)), ("2024-13-02", None), ("Tuesday", None)],
)
def test_iso_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "c string")
    found = cleaners.clean_date(F.col("c"), formats=cleaners.ISO_FORMATS)
    assert df.select(found).first()[0] == day


def test_amounts_beyond_the_type_are_refused(spark):
    df = spark.createDataFrame([("999999999999.5", "1234567890123.5")], "a string, b string")
    assert float(df.select(cleaners.clean_number(F.col("a"), "decimal(18,6)")).first()[0]) == 999999999999.5
    with pytest.raises(Exception, match="amount too large"):
        df.select(cleaners.clean_number(F.col("b"), "decimal(18,6)")).collect()


def test_csv_file_keeps_text_and_file_name(spark, tmp_path):
    path = tmp_path / "dhl may.csv"
    path.write_text(
        "No.De Guia,Importe Neto,Kilos,Fecha Envio,Referencia,Pza, FF \n"
        "0012345678, 118.50 ,2.5,2026-05-05 00:00:00,rt0000000001,3.9,1e1\n"
        "   ,1,1,,,,\n7,12d,x,05/05/2026,,dos,\n"
    )
    raw = carriers.read_raw(spark, str(path))
    rows = {r["waybill"]: r for r in carriers.normalise_invoices(raw, "dhl").collect()}
    assert set(rows) == {"0012345678", "7"}
    first = rows["0012345678"]
    assert float(first["net_amount"]) == 118.5 and first["kilos"] == 2.5 and first["pieces"] == 3
    assert first["is_return"] and float(first["surcharges"]) == 10
    assert first["ship_date"] == dt.date(2026, 5, 5)
    assert first["source_file"].replace("%20", " ") == "dhl may.csv"
    second = rows["7"]
    assert float(second["net_amount"]) == 0 and second["kilos"] == 0 and second["pieces"] is None
    assert second["ship_date"] is None and second["currency"] == "MXN"


def test_second_account_uses_tracking_and_never_returns(spark):
    raw = spark.createDataFrame(
        [("RASTREO1", "G1", "RT1234567890", "10.5", "1", "2", "5/3/2026 9:05")],
        "Rastreo string, `Guía` string, Referencia string, Total string, Otros string, RAD string, "
        "`Fecha envío` string",
    )
    row = carriers.normalise_invoices(raw, "paquete_express_2", "f").first()
    assert (row["carrier"], row["waybill"], row["account"]) == ("paquete_express_2", "RASTREO1", "G1")
    assert row["is_return"] is False and float(row["surcharges"]) == 3
    assert row["ship_date"] == dt.date(2026, 3, 5)


@pytest.mark.parametrize(
    ("text", "day"),
    [("5/3/2026", dt.date(2026, 3, 5)), (" 05/03/2026 10:15:30 ", dt.date(2026, 3, 5)),
     ("05/03/2026 9:5", dt.date(2026, 3, 5)), ("2026-03-05", None), ("31/02/2026", None), ("", None),
     (None, None)],
)
def test_clean_date(spark, text, day):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(cleaners.clean_date(F.col("c"))).first()[0] == day


@pytest.mark.parametrize(
    ("text", "number"),
    [("12", 12.0), (" 1.5 ", 1.5), ("1e3", 1000.0), ("12d", 0.0), ("1.5F", 0.0), ("NaN", 0.0),
     ("Infinity", 0.0), ("", 0.0), (None, 0.0), ("1,5", 0.0), ("-.5", -0.5)],
)
def test_clean_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "c string")
    row = df.select(
        cleaners.clean_number(F.col("c")), cleaners.clean_number(F.col("c"), "decimal(18,6)")
    ).first()
    assert row[0] == number and float(row[1]) == number


@pytest.mark.parametrize(
    ("text", "clean"),
    [("  a \t b  c ", "a b c"), ("   ", None), ("　", None), ("", None), (None, None)],
)
def test_clean_text(spark, text, clean):
    df = spark.createDataFrame([(text,)], "c string")
    row = df.select(cleaners.clean_text(F.col("c")), cleaners.has_text(F.col("c"))).first()
    assert row[0] == clean and row[1] is (clean is not None)


def test_surcharges_share_headers_and_skip_zero(spark):
    raw = spark.createDataFrame(
        [("A", "5", "0"), ("B", "", "x"), (" ", "9", "9")], "Guia string, ODA string, X string"
    )
    mapping = [("Zone", "ODA"), ("Again", "ODA"), ("Other", "X"), ("Gone", "Nope")]
    rows = surcharges.ingest_surcharges(raw, "fedex", mapping).collect()
    assert sorted((r["waybill"], r["concept"], float(r["amount"])) for r in rows) == [
        ("A", "Again", 5.0), ("A", "Zone", 5.0),
    ]


def test_client_invoices_without_total_are_refused(spark):
    raw = spark.createDataFrame([("1", "x")], "guia string, Cliente string")
    with pytest.raises(ValueError):
        carriers.normalise_client_invoices(raw, "f")


def test_only_the_latest_version_of_a_fact_counts(spark):
    facts = "transaction_id long, version int, transaction_type string, reference string, amount double"
    wallet = spark.createDataFrame(
        [(1, 10, "Cargo por sobrepeso", "W", 10.0), (1, 12, "Cargo por sobrepeso", "W", 12.0),
         (2, 1, "Cargo por sobrepeso", "W", 1.0), (3, 1, "Cargo por sobrepeso", "V", 5.0), (3, 2, "other", "V", 5.0)],
        facts,
    )
    rows = {r["waybill"]: float(r["amount"]) for r in mirror.overweight_rollup(wallet).collect()}
    assert rows == {"W": 13.0}
    recharges = spark.createDataFrame(
        [(1, 1, 7, "N", 50.0, dt.datetime(2025, 1, 1)), (1, 2, 7, "N", 20.0, dt.datetime(2025, 1, 1))],
        "recharge_id long, version int, seller_id long, seller_name string, amount double, created_at timestamp_ntz",
    )
    assert float(mirror.recharge_rollup(recharges).first()["recharges"]) == 20


def test_union_rejects_another_schema(spark):
    good = b.invoices(spark, [b.line("W", 1)])
    assert carriers.canonical_union([good, good]).count() == 2
    with pytest.raises(ValueError):
        carriers.canonical_union([good, good.drop("zone")])


def test_latest_shipment_skips_nulls_per_column(spark):
    facts = spark.createDataFrame(
        [("W", 1, "Old", "p", 5, dt.datetime(2026, 1, 1), "DHL", 1, 1),
         ("W", None, None, "q", 9, dt.datetime(2026, 2, 1), "DHL", 2, 1),
         ("W", 3, "Other", "q", 9, dt.datetime(2026, 3, 1), "ELSE", 3, 2),
         ("W", 3, "Moved", "q", 9, dt.datetime(2026, 4, 1), "DHL", 3, 1)],
        "waybill string, seller_id long, seller_name string, payment_model string, sale_price int, "
        "created_at timestamp_ntz, carrier_name string, shipment_id long, version int",
    )
    row = mirror.latest_shipment(facts, ["DHL"]).first()
    assert (row["seller_id"], row["seller_name"], row["payment_model"]) == (1, "Old", "q")
    assert row["created_at"] == dt.datetime(2026, 2, 1)


def test_replace_slice_clears_only_named_slices(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(r["v"] for r in tables.replace_slice(old, new, ["k"]).collect()) == [2, 3, 9]
    none = spark.createDataFrame([(None, 8)], "k string, v int")
    assert sorted(r["v"] for r in tables.replace_slice(old, none, ["k"]).collect()) == [1, 2, 8]
    cleared = tables.replace_slice(old, new.limit(0), ["k"], slices=new)
    assert sorted(r["v"] for r in cleared.collect()) == [2, 3]


def test_evolve_schema_adds_typed_nulls(spark):
    old = spark.createDataFrame([(1, "c")], "seller_id long, client string")
    new = schemas.evolve_schema(old, schemas.CREDIT_CONFIG)
    schemas.check_schema(new, schemas.CREDIT_CONFIG)
    assert new.first()["margin"] is None


def test_written_slices_and_month_pruning(spark, tmp_path):
    rows = [{"waybill": f"W{i}", "ship_month": m, "cost": i} for i, m in
            enumerate(["2026-01", "2026-02", None])]
    recon = b.frame(spark, schemas.RECONCILIATION, rows)
    stored = tables.write_reconciliation(recon, str(tmp_path / "r"))
    schemas.check_schema(stored, schemas.RECONCILIATION)
    assert stored.count() == 3 and stored.filter("ship_month is null").count() == 1
    plan = stored.filter("ship_month = '2026-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ship_month" in plan
    tables.write_slices(
        recon.filter("ship_month = '2026-01'").withColumn("waybill", F.lit("NEW")),
        str(tmp_path / "r"), ["ship_month"],
    )
    spark.catalog.refreshByPath(str(tmp_path / "r"))
    found = spark.read.schema(stored.schema).parquet(str(tmp_path / "r"))
    assert sorted(r["waybill"] for r in found.collect()) == ["NEW", "W1", "W2"]


FACTS = (
    "shipment_id long, version int, waybill string, carrier_name string, seller_id long, seller_name string,"
    " payment_model string, sale_price decimal(18,6), created_at timestamp_ntz"
)


def _facts(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        rows.append((
            rng.randrange(40), rng.randrange(6), f"W{rng.randrange(25)}", rng.choice(["DHL", "FEDEX"]),
            rng.choice([None, 1, 2]), rng.choice([None, "A", "B"]), rng.choice([None, "", "Prepago"]),
            rng.choice([None, Decimal(rng.randrange(9))]), dt.datetime(2026, 1, rng.randrange(1, 9)),
        ))
    return spark.createDataFrame(rows, FACTS)


def test_two_batches_equal_one_full_run(spark, tmp_path):
    first, second = _facts(spark, 120, 1), _facts(spark, 60, 2)
    both = first.unionByName(second).unionByName(first.limit(20))
    state = mirror.dedup_by_id(first, "shipment_id", "version", *mirror.SHIPMENT_TIES)
    state = tables.stored(state, f"{tmp_path}/state")
    after, merged = mirror.merge_shipments(state, mirror.latest_shipment(state), second.unionByName(first.limit(20)))
    want = mirror.dedup_by_id(both, "shipment_id", "version", *mirror.SHIPMENT_TIES)
    assert sorted(map(repr, after.collect())) == sorted(map(repr, want.select(after.columns).collect()))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, mirror.latest_shipment(both).collect()))


def test_late_older_versions_and_replays_change_nothing(spark, tmp_path):
    facts = _facts(spark, 150, 3)
    state = mirror.dedup_by_id(facts, "shipment_id", "version", *mirror.SHIPMENT_TIES)
    state = tables.stored(state, f"{tmp_path}/state")
    changed, gone = mirror.merge_latest(state, facts, "shipment_id", "version", *mirror.SHIPMENT_TIES)
    assert changed.count() == gone.count() == 0
    older = state.withColumn("version", F.col("version") - 1).withColumn("waybill", F.lit("W_old"))
    after, merged = mirror.merge_shipments(state, mirror.latest_shipment(state), older)
    assert after.exceptAll(state).count() == 0
    assert "W_old" not in {r["waybill"] for r in merged.collect()}
    assert mirror.high_water(state) == max(r["version"] for r in facts.collect())


def test_tied_versions_keep_one_row(spark):
    facts = _facts(spark, 200, 4).withColumn("version", F.lit(1))
    latest = mirror.dedup_by_id(facts, "shipment_id", "version", *mirror.SHIPMENT_TIES).collect()
    assert len({r["shipment_id"] for r in latest}) == len(latest)
    again = mirror.dedup_by_id(facts.repartition(7), "shipment_id", "version", *mirror.SHIPMENT_TIES).collect()
    assert sorted(map(repr, latest)) == sorted(map(repr, again))


def test_rows_with_amounts_too_large_can_be_set_aside(spark):
    spec = carriers.HEADER_MAPS["dhl"]
    amount = spec.headers["net_amount"]
    raw = spark.createDataFrame(
        [("W1", "12.5", "f.csv"), ("W2", "9" * 13, "f.csv"), ("W3", "n/a", "g.csv"), (None, "9" * 20, "g.csv"), ("W4", "-1e12", "g.csv")],
        f"`{spec.headers['waybill']}` string, `{amount}` string, source_file string",
    )
    refused = carriers.refused_rows(raw, "dhl").collect()
    assert sorted((r["waybill"], r["source_file"]) for r in refused) == [("W2", "f.csv"), ("W4", "g.csv")]
    loaded = carriers.normalise_invoices(carriers.without_refused(raw, "dhl"), "dhl").collect()
    assert {r["waybill"]: r["net_amount"] for r in loaded} == {"W1": Decimal("12.5"), "W3": 0}
    with pytest.raises(Exception, match="too large"):
        carriers.normalise_invoices(raw, "dhl").collect()


def test_arrays_of_cells_are_cleaned_like_single_cells(spark):
    texts = [None, "", "  ", " a  b ", " x\ty", "12", "12d", "1e3", " 7 ", "-0.0000005", "999999999999.9999994", "NaN", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = df.select(
        cleaners.clean_texts(F.array("c"))[0].alias("t"), cleaners.clean_text(F.col("c")).alias("t1"),
        cleaners.clean_amounts(F.array("c"), schemas.AMOUNT)[0].alias("n"), cleaners.clean_number(F.col("c"), schemas.AMOUNT).alias("n1"),
    )
    for r in got.collect():
        assert r["t"] == r["t1"] and r["n"] == r["n1"]


def test_only_texts_with_odd_blanks_meet_the_pattern(spark):
    plain = ["", " ", "a", " Gu\u00eda de env\u00edo ", "a b c", "  a", "x" * 5000]
    odd = ["a  b", "a  ", "a\n", "\ta", "a\xa0b", "a\u2003b", "\x85", "a \u3000"]
    rows = spark.createDataFrame([(t,) for t in plain + odd], "c string")
    shown = rows.select("c", F.col("c").rlike(cleaners.PLAIN_TEXT), cleaners.collapsed(F.col("c"))).collect()
    assert [r[1] for r in shown] == [True] * len(plain) + [False] * len(odd)
    assert all(r[2] == " ".join(r["c"].split()) for r in shown)


def test_a_stored_comparison_is_worked_out_once(spark, tmp_path):
    """With a store the mirror after a batch is the same, and its plan ranks no batch again."""
    first, second = _facts(spark, 200, 5), _facts(spark, 200, 6)
    lost = second.limit(5).withColumn("waybill", F.lit(None).cast("string"))
    state = mirror.dedup_by_id(first, "shipment_id", "version", *mirror.SHIPMENT_TIES)
    state = tables.stored(state, f"{tmp_path}/state")
    before = tables.stored(mirror.latest_shipment(state), f"{tmp_path}/mirror")
    batch, paths = second.unionByName(lost.withColumn("version", F.col("version") + 1)), []

    def store(df):
        paths.append(f"{tmp_path}/changes{len(paths)}")
        return tables.stored(df, paths[-1])

    plain = mirror.merge_shipments(state, before, batch)
    kept = mirror.merge_shipments(state, before, batch, store)
    assert len(paths) == 1
    for one, two in zip(plain, kept, strict=True):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert "row_number" not in kept[1]._jdf.queryExecution().optimizedPlan().toString()
