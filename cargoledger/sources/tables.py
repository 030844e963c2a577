"""Table maintenance: slices, appends, load log and written tables."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.schemas import LOAD_LOG, conform


def append_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after an append; columns are matched by name."""
    return current.unionByName(batch)


def replace_slice(
    current: DataFrame, batch: DataFrame, keys: list[str], slices: DataFrame | None = None
) -> DataFrame:
    """Delete the slices named by ``keys`` and insert ``batch``.

    ``slices`` lists the slice keys to clear, by default those found in the batch. A NULL key
    equals a NULL key. The list of slices is distinct and slim, whatever the batch holds.
    """
    cleared = (batch if slices is None else slices).select(keys).distinct()
    cleared = cleared.select([F.col(k).alias(f"_slice_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_slice_{k}")) for k in keys]
    return current.join(cleared, same, "left_anti").unionByName(batch)


def replace_all(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Full reload: the batch in the table's column order."""
    return batch.select(current.columns)


def log_entry(
    loaded: DataFrame, table: str, carrier: str, since: str, loaded_at: str
) -> DataFrame:
    """One load-log row for a finished load; the count runs on the executors."""
    row = loaded.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table_name"),
        F.lit(carrier).alias("carrier"),
        F.lit(since).alias("since"),
        "row_count",
        F.lit(loaded_at).alias("loaded_at"),
    )
    return conform(row, LOAD_LOG)


def counted_write(
    df: DataFrame, path: str, partition_by: list[str] | None = None
) -> tuple[DataFrame, int]:
    """Write a table and count its rows on the way, in the one job that writes them."""
    seen = Observation()
    write_overwrite(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns), seen.get["rows"]


def counted_entry(
    spark: SparkSession, rows: int, table: str, carrier: str, since: str, loaded_at: str
) -> DataFrame:
    """One load-log row for a load that was counted as it was written."""
    row = spark.range(1).select(
        F.lit(table).alias("table_name"), F.lit(carrier).alias("carrier"), F.lit(since).alias("since"),
        F.lit(rows).alias("row_count"), F.lit(loaded_at).alias("loaded_at"),
    )
    return conform(row, LOAD_LOG)


def load_log(log: DataFrame, entry: DataFrame) -> DataFrame:
    """The log with one more entry."""
    return log.unionByName(entry)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def write_append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def write_overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, which also gives the planner its true size."""
    write_overwrite(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries.

    Spark deletes them once the driver has collected the objects that refer to them, which a driver
    with free memory may not do for hours. What the first pass releases a second one finds.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.2)
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_slices(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table in its own column order; partition columns would come last otherwise."""
    return spark.read.schema(schema).parquet(path).select(schema.names)


def in_slices(keys: list[str], slices: list[tuple]) -> Column:
    """Whether a row is in one of the slices; on partition columns this prunes directories."""
    each = [reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, s, strict=True)]) for s in slices]
    return reduce(or_, each, F.lit(False))


def drop_slices(spark: SparkSession, path: str, keys: list[str], slices: list[tuple]) -> None:
    """Delete partition directories."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for values in slices:
        folder = "/".join(name(k, v) for k, v in zip(keys, values, strict=True))
        remove(spark, f"{path.rstrip('/')}/{folder}")


def upsert_slices(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: list[str],
    touched: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    staging: str,
) -> DataFrame:
    """Replace the touched slices of a table that is partitioned by ``keys``; returns the table.

    ``build`` gets the stored rows of those slices, read from their directories alone, and returns what they are to
    hold. That is written to ``staging`` first, so a run that is cut off can be repeated, then moved in partition by
    partition; a slice left without rows goes. Other directories are neither read nor written. Only the names of the
    touched slices come to the driver, no more than the table has directories.
    """
    slices = [tuple(r) for r in touched.select(keys).distinct().collect()]
    old = read_table(spark, path, schema).filter(in_slices(keys, slices))
    fresh = stored(build(old).select(schema.names), staging)
    left = {tuple(r) for r in fresh.select(keys).distinct().collect()}
    if strangers := left - set(slices):
        raise ValueError(f"rows outside the touched slices: {sorted(map(repr, strangers))[:3]}")
    write_slices(fresh, path, keys)
    drop_slices(spark, path, keys, [s for s in slices if s not in left])
    return read_table(spark, path, schema)


def write_reconciliation(df: DataFrame, path: str) -> DataFrame:
    """Create or replace the result table, one directory per ship month; read it back.

    The rebalance lets adaptive execution merge small months and split one that holds a third
    of all rows, so file sizes stay even and no task opens a file in every month.
    """
    write_overwrite(df.hint("rebalance", F.col("ship_month")), path, ["ship_month"])
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored.select(df.columns)


def write_reports(reports: dict[str, DataFrame], folder: str, file_format: str = "parquet") -> None:
    """One directory per report."""
    for name, report in reports.items():
        writer = report.write.mode("overwrite")
        if file_format == "csv":
            writer = writer.option("header", "true")
        writer.format(file_format).save(f"{folder.rstrip('/')}/{name}")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="cargoledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
