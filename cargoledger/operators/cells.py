"""Overlapping rate rows -> disjoint cells that hold the winning row of every layer.

A rate row covers a box: its keys, a range of kilos and a range of days. The boxes of a key are swept: their
bounds, sorted, cut the kilo axis into segments; the rows active in a segment are cut again along the day axis; in each
cell the row of least rank wins, per layer. All of it is built-in expressions over one list of rows per group: no range
join, no window, no Python.

A group is a chunk of a key, never a whole hot key. Where a key has more than `CHUNK` different rows, its axes are
split at quantiles of its own bounds (an aggregate that combines before the shuffle), and a row goes to each chunk
that it reaches into, clipped. Quantiles are bounds themselves, so chunks cut no cell that the sweep would not cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key up to which it is swept in one group, and the most parts an axis is split into.
CHUNK, PARTS = 256, 64
VALUE = T.DecimalType(30, 10)


def ranked_rows(rows: DataFrame, keys: dict[str, Column], ranges: dict[str, tuple[Column, Column]],
                order: list[Column], value: Column) -> DataFrame:
    """Keys, low_ and high_ of each axis, rank (least is best) and value; rows that agree but for the value
    are merged to the least value, so work grows with the distinct boxes. Empty boxes and NULL keys go."""
    named = {**keys}
    for axis, (low, high) in ranges.items():
        named |= {f"low_{axis}": low, f"high_{axis}": high}
    rank = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in order]).alias("rank")
    found = rows.select(*[c.alias(k) for k, c in named.items()], rank, value.cast(VALUE).alias("value"))
    full = [F.col(k).isNotNull() for k in keys] + [F.col(f"low_{a}") < F.col(f"high_{a}") for a in ranges]
    return found.filter(reduce(Column.__and__, full)).groupBy(*named, "rank").agg(F.min("value").alias("value"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that is computed once."""
    return F.transform(F.array(value), use)[0]


def _winners(rows: Column, layers: list[str]) -> Column:
    """Best row of each layer; NULL where a layer has none."""

    def best(layer: str) -> Column:
        own = rows if len(layers) == 1 else F.filter(rows, lambda r: r["layer"] == layer)
        return F.array_min(F.transform(own, lambda r: r["best"]))

    return F.array(F.struct(*[best(layer).alias(layer) for layer in layers]))


def _alone(row: Column, axes: list[str], layers: list[str]) -> Column:
    """The one cell of a row that meets no other: its own bounds, and itself as the winner of its layer."""
    bounds = [row[f"{side}_{a}"].alias(f"{a}_{side}") for a in axes for side in ("low", "high")]
    return F.struct(*bounds, *[F.when(row["layer"] == layer, row["best"]).alias(layer) for layer in layers])


def _swept(rows: Column, axes: list[str], layers: list[str]) -> Column:
    """Cells of a list of rows: the bounds of each axis left, and the winners."""
    if not axes:
        return _winners(rows, layers)
    axis, low, high = axes[0], f"low_{axes[0]}", f"high_{axes[0]}"

    def segments(cuts: Column) -> Column:
        n = F.greatest(F.size(cuts) - 1, F.lit(0))
        return F.arrays_zip(F.slice(cuts, 1, n).alias("low"), F.slice(cuts, 2, n).alias("high"))

    def cells(segment: Column) -> Column:
        active = F.filter(rows, lambda r: (r[low] <= segment["low"]) & (r[high] > segment["low"]))
        inner = _bound(active, lambda live: _swept(live, axes[1:], layers))
        rest = [f"{a}_{side}" for a in axes[1:] for side in ("low", "high")] + layers
        return F.transform(
            inner,
            lambda c: F.struct(
                segment["low"].alias(f"{axis}_low"), segment["high"].alias(f"{axis}_high"),
                *[c[name].alias(name) for name in rest],
            ),
        )

    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda r: F.array(r[low], r[high])))))
    swept = _bound(cuts, lambda at: F.flatten(F.transform(segments(at), cells)))
    return F.when(F.size(rows) == 1, F.transform(rows, lambda r: _alone(r, axes, layers))).otherwise(swept)


def _splits(quantiles: Column, parts: Column) -> Column:
    """Where an axis is cut into ``parts``: every so many of its quantiles."""
    steps = F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1)))
    at = F.transform(steps, lambda i: F.get(quantiles, F.floor(i * PARTS / parts).cast("int") - 1))
    return F.when(parts > 1, F.array_sort(F.array_distinct(at))).otherwise(F.slice(quantiles, 1, 0))


def _reached(split: Column, low: Column, high: Column) -> Column:
    """Numbers of the chunks that a range reaches into."""
    open_end = F.lit(True)
    return F.filter(
        F.sequence(F.lit(0), F.size(split)),
        lambda i: F.coalesce(high > F.get(split, i - 1), open_end) & F.coalesce(low < F.get(split, i), open_end),
    )


def _chunked(rows: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Rows dealt to the chunks of their key, clipped to them; adds chunk_<axis>.

    Rows are counted first; only keys with too many of them get quantiles, which cost far more than a count.
    """
    quantiles = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHUNK).select(keys)
    # a stage of its own, so that the planner sees how few they are before it joins, mostly none
    sizes = rows.join(large.hint("rebalance"), keys, "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile_approx(f"low_{a}", quantiles, F.lit(1000)).alias(f"_q_{a}") for a in axes],
    )
    wanted = F.ceil(F.col("_n") / CHUNK)
    for k, axis in enumerate(axes):
        parts = F.least(F.lit(PARTS), F.greatest(F.lit(1), F.ceil(wanted / PARTS**k))).cast("int")
        sizes = sizes.withColumn(f"_split_{axis}", _splits(F.col(f"_q_{axis}"), parts))
    dealt = rows.join(sizes.select(*keys, *[f"_split_{a}" for a in axes]), keys, "left")
    for axis in axes:
        low, high = F.col(f"low_{axis}"), F.col(f"high_{axis}")
        split = F.coalesce(f"_split_{axis}", F.array().cast(dealt.schema[f"_split_{axis}"].dataType))
        dealt = dealt.withColumn(f"chunk_{axis}", F.explode(_reached(split, low, high)))
        chunk = F.col(f"chunk_{axis}")
        dealt = dealt.withColumns(
            {f"low_{axis}": F.greatest(low, F.get(split, chunk - 1)), f"high_{axis}": F.least(high, F.get(split, chunk))}
        )
    return dealt


def compile_cells(layers: dict[str, DataFrame], keys: list[str], axes: list[str]) -> DataFrame:
    """keys, <axis>_low and <axis>_high, and per layer its winner as struct(rank, none, value), NULL without one.

    ``layers`` are results of `ranked_rows` with the same keys and axes.
    """
    best = F.struct("rank", F.col("value").isNull().alias("none"), "value").alias("best")
    bounds = [f"{side}_{a}" for a in axes for side in ("low", "high")]
    parts = [df.select(*keys, *bounds, F.lit(name).alias("layer"), best) for name, df in layers.items()]
    rows = _chunked(reduce(DataFrame.unionByName, parts), keys, axes) if axes else reduce(DataFrame.unionByName, parts)
    groups = rows.groupBy(*keys, *[f"chunk_{a}" for a in axes]).agg(
        F.collect_list(F.struct(*bounds, "layer", "best")).alias("rows")
    )
    cells = groups.select(*keys, F.inline(_swept(F.col("rows"), axes, list(layers))))
    return cells.filter(reduce(Column.__or__, [F.col(name).isNotNull() for name in layers]))
