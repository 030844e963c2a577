"""Registered queries of the subpackage against DuckDB, where SQL can express them, or their laws."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entrypoint
from cargoledger.llm import queries

FOLDER = entrypoint.SMOKE_FOLDER
TABLES = ("documents", "pages", "benchmark", "conversations", "embeddings", "labels")
#: Rows per row of the table a query is about; None where the number is the query's own matter.
ABOUT = {
    "op1_warc_salvage": "pages",
    "op2_secret_ledger": "documents",
    "op4_license_scan": "documents",
    "op5_substring_dedup": "documents",
    "op7_quality_rules": "documents",
    "op8_balanced_shards": "documents",
    "op10_simhash_dedup": "documents",
    "op12_token_counts": "documents",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(repr(r[i]) for i in order) for r in rows)


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entrypoint.queries())
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = queries.QUERIES[name](spark, FOLDER)
    rows = out.collect()
    if name in ABOUT:
        assert len(rows) == duck.execute(f"select count(*) from {ABOUT[name]}").fetchone()[0]
    assert rows
    if name in queries.ORACLE:
        result = duck.execute(queries.ORACLE[name])
        columns = [d[0] for d in result.description]
        assert shown(map(tuple, rows), out.columns) == shown(result.fetchall(), columns)


def test_leaks_are_the_passages_planted(spark, duck):
    rows = queries.QUERIES["op3_latent_decontamination"](spark, FOLDER).collect()
    exact = duck.execute(
        "select d.doc_id, b.item_id from documents d, benchmark b where contains(d.text, b.text)"
    ).fetchall()
    assert exact and set(exact) <= {(r["doc_id"], r["item_id"]) for r in rows}
