"""Connected components by alternating stars (large-star, small-star), as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = common.stored(both.groupBy("a").agg(F.min("b").alias("least")), "least")
    tied = both.where("b > a").join(least, "a")
    return tied.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them. Edges have a > b."""
    least = common.stored(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Node and component (its least node) for every node of the edges (a, b).

    The joins' hot side, a star with many leaves, is a plain shuffle, which adaptive execution
    splits. Every round is a written table; the loop ends when a round changes nothing.
    """
    current = common.stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(current)
    while True:
        current = common.stored(_large_star(current).distinct(), "large-star")
        current = common.stored(_small_star(current).distinct(), "small-star")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    heads = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(heads)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest: equal only if the edges are."""
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
