"""How the given tables are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_FOLDER
from cargoledger.plans import catalog, domain


def test_a_task_reads_a_bounded_part_of_a_table(spark):
    other = spark.newSession()
    other.conf.set(domain.SPLIT_SETTING, "128MB")
    domain.Domain(other, "/nowhere")
    assert domain._bytes(other.conf.get(domain.SPLIT_SETTING)) == domain.SPLIT_BYTES
    other.conf.set(domain.SPLIT_SETTING, "1m")
    domain.Domain(other, "/nowhere")
    assert other.conf.get(domain.SPLIT_SETTING) == "1m"


def test_sizes_with_units():
    assert [domain._bytes(x) for x in ("134217728b", "134217728", "16MB", "2g", "64 KiB")] == [1 << 27, 1 << 27, 1 << 24, 2 << 30, 1 << 16]


@pytest.mark.parametrize("card", ["cost", "fuel", "zone_margin", "kilo_margin", "flat"])
def test_a_lookup_stores_its_own_card_only(spark, monkeypatch, card):
    monkeypatch.setattr(catalog, "_STORED", {})
    w = catalog.Workspace(spark, f"{SMOKE_FOLDER}/.")
    found = catalog.QUERIES[f"lookup_{card}"](w)
    assert [k[2] for k in catalog._STORED] == [f"book-{card}"]
    assert found.filter(F.col(found.columns[-1]).isNotNull()).count() > 0
    if card == "fuel":  # a book that is stored anyway is used
        assert w.book is w.book_for("cost")
