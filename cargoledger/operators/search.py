"""Substring search over stored columns by trigram postings.

A posting says which values hold three given letters in a row, whatever their case. It is kept per distinct value, sorted by
trigram, so a search reads the row groups of its own trigrams. Values that hold all of them are then compared with the
text itself, so the result is that of ILIKE; a text of under three letters, or one with wildcards, is compared with
the distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.sources import tables

GRAM = 3


def trigrams(text: Column) -> Column:
    """Distinct runs of three letters of a text in lower case; none if it is shorter."""
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, grams).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, column: str) -> DataFrame:
    """(gram, value) for every distinct value of a column; also (empty gram, value), the list of values."""
    values = rows.select(F.col(column).alias("value")).filter("value is not null").distinct()
    grams = F.concat(F.array(F.lit("")), trigrams(F.col("value")))
    return values.select(F.explode(grams).alias("gram"), "value")


def store_postings(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Written sorted by gram, split by size where one gram is frequent."""
    placed = postings(rows, column).repartitionByRange("gram", "value").sortWithinPartitions("gram", "value")
    return tables.stored(placed, path)


def grams_of(text: str) -> list[str]:
    """Trigrams a value must hold to match; the empty one where the text gives none."""
    low = text.lower()
    if any(c in low for c in "%_\\"):
        return [""]
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}) or [""]


def matching_values(index: DataFrame, text: str) -> DataFrame:
    """Distinct values that hold the text anywhere, in any case."""
    grams = grams_of(text)
    held = index.filter(F.col("gram").isin(grams) & F.col("value").ilike(f"%{text}%"))
    counted = held.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") == len(grams)).select("value")


def matching_rows(rows: DataFrame, **found: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose columns hold the texts, given per column as (postings, text)."""
    for column, (index, text) in found.items():
        values = matching_values(index, text).withColumnRenamed("value", "_value")
        rows = rows.join(values, F.col(column) == F.col("_value"), "left_semi")
    return rows
