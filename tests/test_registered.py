"""Every registered query against its check SQL, and the plans they run."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entrypoint
from cargoledger.plans import checks
from cargoledger.plans.catalog import Workspace, registered
from cargoledger.plans.domain import GIVEN

FOLDER = entrypoint.SMOKE_FOLDER
# joins that pair all rows, and Python in a plan
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")
QUERIES, CHECKS = registered(), dict(checks.CHECKS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple("" if r[i] is None else repr(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shown)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in NEVER if n in plan]
    found = _sorted([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(CHECKS[name])
    wanted = _sorted(result.fetchall(), [d[0] for d in result.description])
    assert found[1], "no rows"
    assert found == wanted


def test_entrypoint_has_every_query():
    assert set(QUERIES) <= set(entrypoint.queries()) and set(CHECKS) <= set(entrypoint.oracle_sql())


def test_statements_read_no_invoices(spark):
    w = Workspace(spark, FOLDER)
    for name in ("statement_surcharges", "statement_totals"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "row_number" not in plan
    assert w.recon.count() > 0


def test_entry(spark):
    assert entrypoint.entry(spark).limit(1).count() == 1


def test_flagship_places_each_input_once(spark):
    """One shuffle by waybill per input, when nothing is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    w = Workspace(spark, FOLDER)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        from cargoledger.operators import reconcile

        facts = [w.spark.createDataFrame([], df.schema) for df in w.facts]
        base = reconcile.attribute(*facts)
        shuffles = base._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(waybill")
        # invoices, shipments, and the charges for either side (one is reused when run)
        assert shuffles <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
