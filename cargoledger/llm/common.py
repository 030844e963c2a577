"""Written tables in the shared folder, and column names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger.sources.tables import free_shuffles, remove


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    A local session without the setting gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cargoledger-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's own scratch folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/llm-{app}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, path: str | None = None, free: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, lineage cut.

    A join against a stored table, unlike one against an aggregate, can be planned by the table's
    size, and adaptive execution can split its hot keys. `free` is for queries with large shuffles.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if free:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch folder, once its results have been used."""
    remove(spark, f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}")


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The two columns an operator works on, under fixed names, so that others cannot clash."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
