"""Stored tables that change slice by slice, the roll-up of the result, and search by postings."""

from __future__ import annotations

import random
import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.functions.money import CENTS
from cargoledger.operators import reports, rollups, search
from cargoledger.plans.catalog import Workspace
from cargoledger.schemas import RECONCILIATION
from cargoledger.sources import tables

SCHEMA = T.StructType([T.StructField("v", T.IntegerType()), T.StructField("k", T.StringType())])


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_touched_slices_are_read_and_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, ["a", "b/ c", None, "d"][i % 4]) for i in range(40)]
    tables.write_overwrite(spark.createDataFrame(rows, SCHEMA), path, ["k"])
    before, seen = files(path), []

    def build(old):
        seen.append(sorted((r["v"], r["k"]) for r in old.collect() if r["k"] is not None))
        return old.filter("k = 'a'").withColumn("v", F.col("v") + 100).unionByName(
            spark.createDataFrame([(7, "new")], SCHEMA)
        )

    touched = spark.createDataFrame([("a",), ("b/ c",), (None,), ("new",), ("a",)], "k string")
    got = tables.upsert_slices(spark, path, SCHEMA, ["k"], touched, build, f"{tmp_path}/s")
    want = [(v + 100, k) for v, k in rows if k == "a"] + [(v, k) for v, k in rows if k == "d"] + [(7, "new")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert seen == [[(v, k) for v, k in sorted(rows, key=lambda r: (r[0], str(r[1]))) if k in ("a", "b/ c")]]
    after = files(path)
    untouched = {f: t for f, t in before.items() if f.startswith("k=d")}
    assert untouched and untouched.items() <= after.items()
    assert {f.split("/")[0] for f in after} == {"k=a", "k=d", "k=new"}
    pruned = tables.read_table(spark, path, SCHEMA).filter(tables.in_slices(["k"], [("a",), (None,)]))
    assert "PartitionFilters: [" in plan_of(pruned) and "PartitionFilters: []" not in plan_of(pruned)


def test_rows_outside_the_touched_slices_are_refused(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.write_overwrite(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), path, ["k"])
    with pytest.raises(ValueError, match="outside"):
        tables.upsert_slices(
            spark, path, SCHEMA, ["k"], spark.createDataFrame([("a",)], "k string"),
            lambda old: old.withColumn("k", F.lit("b")), f"{tmp_path}/s",
        )
    assert sorted(map(tuple, tables.read_table(spark, path, SCHEMA).collect())) == [(1, "a"), (2, "b")]


def test_load_is_counted_by_the_job_that_writes_it(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    source = spark.range(0, 1000, 1, 7).rdd.map(lambda r: (reads.add(1), (r[0], str(r[0] % 3)))[1])
    df = spark.createDataFrame(source, "v long, k string")
    stored, n = tables.counted_write(df, f"{tmp_path}/t", ["k"])
    assert n == 1000 == stored.count() and reads.value == 1000
    assert tables.counted_write(df.limit(0), f"{tmp_path}/e")[1] == 0


@pytest.fixture(scope="module")
def recon(spark, tmp_path_factory):
    rng = random.Random(6)
    money = lambda: rng.choice([None, Decimal(rng.randrange(9999)) / 100])
    rows = []
    for i in range(600):
        row = dict.fromkeys(RECONCILIATION.names)
        row |= {
            "waybill": f"{rng.randrange(10**6):08d}X", "client": rng.choice([None, "Ana", "ACME_1", "Ñandú 100%", "b"]),
            "status": rng.choice(["billed_ok", "extra_due", "credit_unbilled"]), "account_type": rng.choice(["credit", "prepaid"]),
            "cost": money(), "income": money(), "extra": money(), "ship_month": rng.choice([None, "SIN", "2026-01", "2026-02"]),
            "is_return": False, "has_cost": True,
        }
        rows.append(tuple(row[c] for c in RECONCILIATION.names))
    df = spark.createDataFrame(rows, T.StructType([T.StructField(f.name, T.DecimalType(10, 2) if isinstance(f.dataType, T.DecimalType) else f.dataType) for f in RECONCILIATION]))
    return tables.write_reconciliation(df.select([F.col(f.name).cast(f.dataType) for f in RECONCILIATION]), f"{tmp_path_factory.mktemp('r')}/recon")


def shown(df):
    return [tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()]


def test_reports_from_the_rollup_equal_those_from_waybills(spark, recon, tmp_path):
    path = f"{tmp_path}/rollup"
    rolled = rollups.write_rollup(recon, path)
    periods = spark.createDataFrame([("2026-01", "closed", None)], "month string, status string, closed_at timestamp_ntz")
    pairs = [
        (rollups.summary_by_status(rolled), reports.summary_by_status(recon)), (rollups.kpis(rolled), reports.kpis(recon)),
        (rollups.close_months(rolled, periods), reports.close_months(recon, periods)), (rollups.by_client(rolled), reports.by_client(recon)),
    ]
    for mine, plain in pairs:
        assert shown(mine) == shown(plain)
        scans = [x for x in plan_of(mine).splitlines() if "FileScan" in x]
        assert len(scans) == 1 and "/rollup" in scans[0]
    assert rollups.kpis(rolled.limit(0)).first()["waybills"] == 0
    # a month of the result changes
    changed = recon.withColumn("cost", F.when(F.col("ship_month") == "2026-01", F.lit(1).cast(CENTS)).otherwise(F.col("cost")))
    before = files(path)
    months = spark.createDataFrame([("2026-01",)], "ship_month string")
    again = rollups.refresh_rollup(path, changed, months, f"{tmp_path}/s")
    assert shown(rollups.by_client(again)) == shown(reports.by_client(changed))
    other = {f: t for f, t in before.items() if "2026-01" not in f}
    assert other.items() <= files(path).items()


@pytest.mark.parametrize("text", ["12", "123", "01X", "x", "", "acme", "ACME_1", "ñan", "100%", "_1", "0000", "zzz"])
def test_search_by_postings_equals_ilike(recon, tmp_path, text):
    for column in ("client", "waybill"):
        index = search.store_postings(recon, column, f"{tmp_path}/{column}")
        got = search.matching_rows(recon, **{column: (index, text)})
        want = recon.filter(F.col(column).ilike(f"%{text}%"))
        assert sorted(r["waybill"] for r in got.collect()) == sorted(r["waybill"] for r in want.collect())


def test_pages_follow_each_other_without_offset(recon):
    whole = [r["waybill"] for r in recon.orderBy(F.col("cost").desc_nulls_last(), "waybill").collect()]
    pages, last = [], None
    while True:
        page = reports.waybill_page(recon, 70, last)
        assert "Offset" not in plan_of(page)
        rows = page.collect()
        if not rows:
            break
        pages += [r["waybill"] for r in rows]
        last = (rows[-1]["cost"], rows[-1]["waybill"])
    assert pages == whole


def test_a_step_lets_go_of_its_shuffles_before_the_next(spark, tmp_path):
    """The shuffle files of a stored step are gone when the next one begins; the driver's memory alone would keep them."""
    held = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(" ").split())
    tables.free_shuffles(spark)
    before = held()
    work = Workspace(spark, str(tmp_path))
    kept = work.scratch("step", spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and kept.count() == 7
