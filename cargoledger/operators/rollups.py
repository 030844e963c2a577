"""A stored roll-up of the result, from which reports are taken without reading waybills.

One row per ship month, status and client with sums that can be added up again. It is partitioned by ship month; when months of
the result change, only their part is summed anew. Sums are exact decimals, so a report from the roll-up equals
the one from all waybills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.functions.money import TOTAL, percent
from cargoledger.operators import reports
from cargoledger.sources import tables

KEYS = ("ship_month", "status", "client")
SUMS = ("cost", "income", "realised", "profit", "receivable", "to_accrue")
ROLLUP = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [T.StructField("account_type", T.StringType()), T.StructField("waybills", T.LongType())]
    + [T.StructField(s, TOTAL) for s in SUMS]
)


def rollup(recon: DataFrame) -> DataFrame:
    """Partial sums per month, status and client; partial sums of tasks combine before the shuffle."""
    amounts = {
        "cost": F.col("cost"), "income": F.col("income"), "realised": reports._costed(F.col("income")),
        "profit": reports._when_set(reports._profit()), "receivable": reports._receivable(),
        "to_accrue": reports._to_accrue(),
    }
    sums = [F.sum(c).cast(TOTAL).alias(name) for name, c in amounts.items()]
    grouped = recon.groupBy(*KEYS).agg(F.min("account_type").alias("account_type"), F.count(F.lit(1)).alias("waybills"), *sums)
    return grouped.select(ROLLUP.names)


def write_rollup(recon: DataFrame, path: str) -> DataFrame:
    tables.write_overwrite(rollup(recon), path, ["ship_month"])
    return tables.read_table(recon.sparkSession, path, ROLLUP)


def refresh_rollup(path: str, recon: DataFrame, months: DataFrame, staging: str) -> DataFrame:
    """Sum the named months (column ship_month) of the result anew; the others are not read."""
    names = [(r[0],) for r in months.select("ship_month").distinct().collect()]
    part = recon.filter(tables.in_slices(["ship_month"], names))
    return tables.upsert_slices(
        recon.sparkSession, path, ROLLUP, ["ship_month"], months, lambda old: rollup(part), staging
    )


def _sum(column: str) -> Column:
    return F.sum(column).cast(TOTAL)


def _totals() -> list[Column]:
    margin = (F.sum("income") - F.sum("cost")).cast(TOTAL).alias("margin")
    return [F.sum("waybills").alias("waybills"), _sum("cost").alias("cost"), _sum("income").alias("income"), margin]


def summary_by_status(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("status").agg(*_totals()).orderBy(F.col("cost").desc_nulls_last(), "status")


def kpis(rolled: DataFrame) -> DataFrame:
    return rolled.agg(
        F.coalesce(F.sum("waybills"), F.lit(0)).alias("waybills"), _sum("cost").alias("cost"), _sum("realised").alias("income"),
        _sum("profit").alias("margin"), _sum("receivable").alias("receivable"), _sum("to_accrue").alias("to_accrue"),
    )


def close_months(rolled: DataFrame, periods: DataFrame) -> DataFrame:
    rows = rolled.filter(F.col("ship_month").isNotNull() & (F.col("ship_month") != reports.REALISED_MISSING))
    months = rows.groupBy(F.col("ship_month").alias("month")).agg(
        F.sum("waybills").alias("waybills"), _sum("cost").alias("cost"), _sum("realised").alias("income"),
        _sum("profit").alias("profit"), _sum("receivable").alias("receivable"), _sum("to_accrue").alias("to_accrue"),
    )
    return reports.with_period_state(months, periods)


def by_client(rolled: DataFrame) -> DataFrame:
    whole = F.sum("cost")
    return (
        rolled.groupBy("client")
        .agg(
            F.min("account_type").alias("account_type"), *_totals(),
            percent((F.sum("income") - whole), whole).alias("margin_pct"),
        )
        .orderBy(F.col("cost").desc_nulls_last(), F.col("client").asc_nulls_last())
    )
