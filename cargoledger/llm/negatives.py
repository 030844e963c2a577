"""Hard negatives by exact integer inner products, Strassen's multiplication on tiles.

Anchors are the rows whose id is divisible by `EVERY`. Every anchor meets every row, in tiles: rows are packed
into blocks of `ROWS`, anchors into blocks of about `ANCHORS`, and a tile is the product of an anchor block and a row
block. Tiles are joined by (anchor block, salt), so rows travel as packed blocks, never as pairs.

Method. A component x becomes floor(256 x). A tile's scores come from Strassen's recursion on int64: blocks are
padded with zeros to even sizes, halved, and multiplied with seven products in place of eight until a side is at most
`LEAF`. Its sums may wrap, but modulo 2**64 they are exact, and no score reaches 2**62 (that is checked, below); so the
scores are exact. Two passes follow:

1. Positives: per anchor a heap of the first `POSITIVES` other rows of its label. A task merges the heaps of its tiles and emits
   one per anchor block; those are merged per anchor block.
2. Windows: per anchor and positive a heap of the first `NEGATIVES` rows of other labels with a score from four fifths of
   the positive's up to it, merged the same way.

Heaps are arrays of fixed size per anchor block, and merging is associative, so neither the order of tiles nor a lost
task changes a result. Higher scores come first, ties by the smaller id. A task holds one tile and a few heaps.

Scores of all rows for one anchor in a hundred are work that grows with the square of the rows; exact results have no way
around it. Rows are shuffled once per anchor block of each pass, as integers of the least width that holds them.

Rows. Without an id, a label or a vector, or with a null or non-finite component, a row takes no part. Repeated rows count
each; an anchor's own id is never its positive. Vectors of different lengths: missing components are zero. Components so large
that a score could reach 2**62 are refused, naming the bound. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.llm import common

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 5, 256
ROWS, ANCHORS, LEAF = 2048, 1024, 32
#: Cells that the rows of one anchor block are dealt to, if it is the only one.
SALTS = 64
NONE = np.iinfo(np.int64).min
BLOCK = "ids binary, labels binary, cells binary, kind string, n int, d int, most double"
HEAP = "g int, seq int, scores binary, ids binary"
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices of any shapes that fit, modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,jk->ik", a, b)
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    y, x, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:y, :x], a[:y, x:], a[y:, :x], a[y:, x:]
    b11, b12, b21, b22 = b[:x, :z], b[:x, z:], b[x:, :z], b[x:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * y, 2 * z), np.int64)
    out[:y, :z] = p1 + p4 - p5 + p7
    out[:y, z:] = p3 + p5
    out[y:, :z] = p2 + p4
    out[y:, z:] = p1 - p2 + p3 + p6
    return out[:m, :n]


# --- blocks -------------------------------------------------------------------------------------


def _whole_rows(vectors: pa.Array, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows whose components are all there and finite."""
    bad = np.flatnonzero(~np.isfinite(cells))  # a null is NaN here
    good = np.ones(len(vectors), bool)
    good[np.searchsorted(np.cumsum(sizes), bad, side="right")] = False
    return good


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their integer cells (as float64), shorter ones padded with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = _whole_rows(vectors, flat, sizes)
    width = int(sizes[good].max(initial=0))
    out = np.zeros((int(good.sum()), width))
    keep = np.repeat(good, sizes)
    row = np.repeat(np.arange(len(out)), sizes[good])
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes[good]) - sizes[good], sizes[good])
    out[row, column] = np.floor(SCALE * flat[keep])
    return good, out


def _packed(ids: np.ndarray, labels: np.ndarray, cells: np.ndarray) -> dict:
    """A block, rows by id, cells in the least integer type that holds them."""
    order = np.argsort(ids, kind="stable")
    most = float(np.abs(cells).max(initial=0))
    kind = next((k for k in ("i1", "i2", "i4") if most <= np.iinfo(k).max), "i8")
    return {
        "ids": ids[order].tobytes(),
        "labels": labels[order].tobytes(),
        "cells": cells[order].astype(kind).tobytes() if most < 2.0**62 else b"",
        "kind": kind,
        "n": len(ids),
        "d": cells.shape[1],
        "most": most,
    }


def _pack_task(size: int):
    """Blocks of at most `size` rows from the batches of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush():
            width = max(c.shape[1] for *_, c in held)
            cells = np.concatenate([np.pad(c, ((0, 0), (0, width - c.shape[1]))) for *_, c in held])
            row = _packed(*(np.concatenate([h[i] for h in held]) for i in (0, 1)), cells)
            return pa.RecordBatch.from_pylist([row], _schema())

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                good, cells = _matrix(part["embedding"])
                ids, labels = (part[c].to_numpy(zero_copy_only=False)[good].astype(np.int64) for c in ("vec_id", "label"))
                start = 0
                while start < len(ids):
                    end = min(len(ids), start + size - n)
                    held.append((ids[start:end], labels[start:end], cells[start:end]))
                    n, start = n + end - start, end
                    if n == size:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    return task


def _schema() -> pa.Schema:
    binary = [(c, pa.binary()) for c in ("ids", "labels", "cells")]
    return pa.schema([*binary, ("kind", pa.string()), ("n", pa.int32()), ("d", pa.int32()), ("most", pa.float64())])


def taking_part(rows: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """The three columns under fixed names; rows without any of them go. Components are looked at when packed."""
    named = rows.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).alias("embedding"),
    )
    return named.dropna()


def relabelled(rows: DataFrame, label_column: str = "label", id_column: str = "vec_id") -> DataFrame:
    """Every seventh id gets the next of ten labels."""
    label = F.col(label_column).cast("long")
    return rows.withColumn(label_column, F.when(F.col(id_column) % 7 == 0, (label + 1) % 10).otherwise(label))


def blocks(rows: DataFrame) -> DataFrame:
    return common.stored(rows.mapInArrow(_pack_task(ROWS), BLOCK), "rows")


def anchor_blocks(rows: DataFrame, every: int = EVERY) -> tuple[DataFrame, int]:
    """Packed anchors with their block (g, seq), and the number of different g."""
    chosen = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, ceil(chosen.count() / ANCHORS))
    numbered = chosen.repartition(groups).mapInArrow(_pack_task(2 * ANCHORS), BLOCK)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the upper bits name the partition
    named = numbered.select("*", F.spark_partition_id().alias("g"), row.cast("int").alias("seq"))
    return common.stored(named, "anchors"), groups


def check_bound(packed: DataFrame) -> None:
    """Refuse components with which a score could leave int64."""
    d, most = packed.agg(F.max("d"), F.max("most")).first()
    if d and d * most * most >= 2.0**62:
        raise ValueError(f"a score of {d} components up to {most:g} could reach 2**62")


def _cells(row: dict) -> np.ndarray:
    return np.frombuffer(row["cells"], row["kind"]).reshape(row["n"], row["d"]).astype(np.int64)


# --- heaps --------------------------------------------------------------------------------------


def merged(scores: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` entries of every row: higher scores first, then smaller ids; NONE is an empty place."""
    order = np.lexsort((ids, ~scores), axis=-1)[..., :size]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def empty_heap(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, size), NONE), np.zeros((n, size), np.int64)


def _firsts(row: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Heaps of n rows from entries (row, score, id)."""
    order = np.lexsort((ids, ~score, row))
    row, score, ids = row[order], score[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    kept = place < size
    out = empty_heap(n, size)
    out[0][row[kept], place[kept]] = score[kept]
    out[1][row[kept], place[kept]] = ids[kept]
    return out


def _added(heap, row, score, ids):
    """A heap with the best of more entries."""
    size = heap[0].shape[1]
    more = _firsts(row, score, ids, len(heap[0]), size)
    return merged(np.hstack([heap[0], more[0]]), np.hstack([heap[1], more[1]]), size)


def _best(scores: np.ndarray, allowed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first `size` allowed entries of each row are, and all that tie with the last of them."""
    if scores.shape[1] > size and allowed.sum() > 4 * size * len(scores):
        only = np.where(allowed, scores, NONE)
        last = np.partition(only, scores.shape[1] - size, axis=1)[:, scores.shape[1] - size]
        allowed = allowed & (scores >= last[:, None])
    return np.nonzero(allowed)


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a positive's negatives: 80 p <= 100 n <= 100 p, without a product that overflows."""
    least = np.where(positive == NONE, np.iinfo(np.int64).max, positive - positive // 5)
    return least, positive


def _tile_scores(tile: dict) -> np.ndarray:
    anchors, rows = _cells(tile["a"]), _cells(tile)
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
    return strassen(anchors, np.ascontiguousarray(rows.T))


def _names(tile: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(x[c], np.int64) for x in (tile["a"], tile) for c in ("ids", "labels"))


def add_positives(heap, tile: dict):
    ids, labels, row_ids, row_labels = _names(tile)
    if heap is None:
        heap = empty_heap(len(ids), POSITIVES)
    scores = _tile_scores(tile)
    allowed = (labels[:, None] == row_labels) & (ids[:, None] != row_ids) & (scores >= heap[0][:, -1:])
    at, column = _best(scores, allowed, POSITIVES)
    return _added(heap, at, scores[at, column], row_ids[column])


def add_negatives(heap, tile: dict):
    """Heaps of the windows, POSITIVES per anchor, one after the other."""
    ids, labels, row_ids, row_labels = _names(tile)
    if heap is None:
        heap = empty_heap(len(ids) * POSITIVES, NEGATIVES)
    scores = _tile_scores(tile)
    least, most = windows(np.frombuffer(tile["a"]["scores"], np.int64).reshape(-1, POSITIVES))
    wide = (labels[:, None] != row_labels) & (scores >= least.min(1)[:, None]) & (scores <= most.max(1)[:, None])
    for k in range(POSITIVES):
        allowed = wide & (scores >= least[:, k : k + 1]) & (scores <= most[:, k : k + 1])
        allowed &= scores >= heap[0][k::POSITIVES, -1:]
        at, column = _best(scores, allowed, NEGATIVES)
        more = _added((heap[0][k::POSITIVES], heap[1][k::POSITIVES]), at, scores[at, column], row_ids[column])
        heap[0][k::POSITIVES], heap[1][k::POSITIVES] = more
    return heap


#: Anchor blocks whose heaps a task holds at once.
HELD = 16


def _tile_task(add):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], tuple] = {}

        def flush():
            rows = [
                {"g": g, "seq": seq, "scores": h[0].tobytes(), "ids": h[1].tobytes()} for (g, seq), h in heaps.items()
            ]
            heaps.clear()
            fields = [("g", pa.int32()), ("seq", pa.int32()), ("scores", pa.binary()), ("ids", pa.binary())]
            return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

        for batch in batches:
            for r in range(batch.num_rows):
                tile = batch.slice(r, 1).to_pylist()[0]
                key = tile["g"], tile["a"]["seq"]
                if key not in heaps and len(heaps) == HELD:
                    yield flush()
                heaps[key] = add(heaps.get(key), tile)
        if heaps:
            yield flush()

    return task


def _merge_heaps(size: int):
    def merge(table: pa.Table) -> pa.Table:
        done = None
        for scores, ids in zip(table["scores"].to_pylist(), table["ids"].to_pylist(), strict=True):
            part = [np.frombuffer(x, np.int64).reshape(-1, size) for x in (scores, ids)]
            done = merged(*(np.hstack(x) for x in zip(done, part, strict=True)), size) if done else part
        first = table.slice(0, 1)
        return pa.table(
            {"g": first["g"], "seq": first["seq"], "scores": [done[0].tobytes()], "ids": [done[1].tobytes()]},
            schema=pa.schema([("g", pa.int32()), ("seq", pa.int32()), ("scores", pa.binary()), ("ids", pa.binary())]),
        )

    return merge


def all_tiles(rows: DataFrame, anchors: DataFrame, groups: int, add, size: int) -> DataFrame:
    """Every anchor block against every block of rows: the merged heaps per anchor block."""
    salts = max(1, min(ceil(SALTS / groups), rows.count()))
    salt = F.pmod(F.xxhash64("ids", "cells"), F.lit(salts)).cast("int")
    left = rows.select("*", salt.alias("salt")).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = anchors.select("g", F.struct(*[c for c in anchors.columns if c != "g"]).alias("a"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    heaps = left.join(right, ["g", "salt"]).mapInArrow(_tile_task(add), HEAP)
    return common.stored(heaps.groupBy("g", "seq").applyInArrow(_merge_heaps(size), HEAP), "heaps")


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            names = np.frombuffer(block["ids"], np.int64)
            p_score, p_id = (np.frombuffer(block[c], np.int64).reshape(-1, POSITIVES) for c in ("scores", "p_ids"))
            n_score, n_id = (
                np.frombuffer(block[c], np.int64).reshape(-1, POSITIVES, NEGATIVES) for c in ("n_scores", "n_ids")
            )
            anchor, k, rank = np.nonzero(n_score != NONE)
            columns = [
                names[anchor], p_id[anchor, k], (rank + 1).astype(np.int32), n_id[anchor, k, rank],
                p_score[anchor, k], n_score[anchor, k, rank],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in RESULT.split(", ")])


def hard_negatives(
    rows: DataFrame,
    every: int = EVERY,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for every anchor and positive."""
    given = taking_part(rows, id_column, label_column, vector_column)
    packed = blocks(given)
    check_bound(packed)
    anchors, groups = anchor_blocks(given, every)
    positives = all_tiles(packed, anchors, groups, add_positives, POSITIVES).withColumnRenamed("ids", "p_ids")
    known = common.stored(anchors.join(positives, ["g", "seq"]), "anchors")
    negatives = all_tiles(packed, known, groups, add_negatives, NEGATIVES).select(
        "g", "seq", F.col("scores").alias("n_scores"), F.col("ids").alias("n_ids")
    )
    return known.join(negatives, ["g", "seq"]).mapInArrow(_triples, RESULT)
