"""SimHash near-duplicate documents, with pivot distance tables.

Texts have A-Z lower-cased; words are runs of anything but ASCII blanks. Shingles are `size`
words joined by one space, repeats included (the whole sequence where it is shorter). A bit of the
fingerprint is 1 if it is set in more than half of the shingles' XXH64 values (UTF-8, seed 42).
Fingerprints link at `bits` or fewer differing bits; a component is what links reach.

Method. For every distinct fingerprint the Hamming distances to `PIVOTS` fixed reference
fingerprints are computed once. By the triangle inequality two fingerprints that link differ by
at most `bits` in every distance, so a pair with a larger difference in any coordinate is dropped,
and only the rest is verified. The coordinates alone cannot serve as a join key: each spreads over
a few standard deviations of four bits only, so half of all pairs agree in one. Pairs therefore
meet in buckets of equal bit groups: of `bits + 2` groups at least two are untouched by `bits`
changes, and each choice of two groups is a table of buckets. No link is lost.

* Equal fingerprints are one node, so copies cost an aggregate that combines before the shuffle.
* A bucket of more than `TILE` members is cut into slices, and each pair of slices is a task of
  its own; a task emits a spanning forest (at most one edge per member), never all its pairs.
* Components are found by iterated joins; nothing is gathered on the driver.

Rows. Null text: no words, so fingerprint 0, linked like any other. Null id: the row gets its
component, but never names one (a component without any id is null). Repeated rows and ids are kept.
Empty input gives empty output. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm import common
from cargoledger.llm.components import connected_components
from cargoledger.llm.words import blocks, random_words

SHINGLE = 3
BITS = 3
SEED = 42
PIVOTS = 16
TILE = 1000
#: Groups of up to this many members are compared by shifting whole columns.
SMALL = 24


def text_fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Fingerprint of one list of words, in pieces of bounded size."""
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(lengths + 1) - lengths - 1
    size = min(size, len(words))
    starts, ends = start[: len(words) - size + 1], (start + lengths)[size - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 1 << 15):
        pieces = zip(starts[k : k + (1 << 15)].tolist(), ends[k : k + (1 << 15)].tolist(), strict=True)
        values = np.array([digest(joined[a:b], SEED) for a, b in pieces], np.uint64)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprint_task(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in blocks(batch["text"], lower=True):
                data = block.data.tobytes()
                for r in range(block.rows):
                    a, b = block.first[r], block.first[r + 1]
                    words = data[block.start[a] : block.end[b - 1]].split() if b > a else []
                    out.append(text_fingerprint(words, size))
            values = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(values)],
                ["doc_id", "text_hash", "fingerprint"],
            )

    return task


def fingerprints(
    docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, text_hash and fingerprint (the 64 bits as a long) per row."""
    texts = common.id_and_text(docs, id_column, text_column).withColumn("text_hash", F.xxhash64("text"))
    schema = (
        T.StructType()
        .add("doc_id", texts.schema["doc_id"].dataType)
        .add("text_hash", T.LongType())
        .add("fingerprint", T.LongType())
    )
    return texts.mapInArrow(_fingerprint_task(size), schema)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_distances(fingerprint: Column) -> Column:
    """Distances to the reference fingerprints, eight to a long, one byte each."""
    references = [signed(int(x)) for x in random_words(10, PIVOTS)]

    def eight(part: list[int]) -> Column:
        distances = (
            F.shiftleft(F.bit_count(fingerprint.bitwiseXOR(F.lit(p))).cast("long"), 8 * k)
            for k, p in enumerate(part)
        )
        return reduce(Column.bitwiseOR, distances)

    return F.array(*(eight(references[k : k + 8]) for k in range(0, PIVOTS, 8)))


def bucket_masks(bits: int) -> list[int]:
    """One mask per choice of two of `bits + 2` groups of adjacent bits."""
    edges = [round(64 * k / (bits + 2)) for k in range(bits + 3)]
    groups = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [signed(a | b) for a, b in combinations(groups, 2)]


def linked(
    left: np.ndarray, right: np.ndarray, values: np.ndarray, table: np.ndarray, bits: int
) -> np.ndarray:
    """Which pairs of positions link: pivot table first, one coordinate after the other, then
    the exact distance of the survivors."""
    alive = np.arange(len(left))
    for k in range(table.shape[1]):
        coordinate = table[:, k]
        near = np.abs(coordinate[left[alive]] - coordinate[right[alive]]) <= bits
        alive = alive[near]
    exact = np.bitwise_count(values[left[alive]] ^ values[right[alive]]) <= bits
    return alive[exact]


def spanning_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n positions the least position it is connected with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _link_groups(group: np.ndarray, values: np.ndarray, table: np.ndarray, bits: int):
    """Edges (fingerprint, fingerprint) of whole groups of adjacent rows."""
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(first, append=len(group))
    lefts, rights = [], []

    def keep(left: np.ndarray, right: np.ndarray) -> None:
        ok = linked(left, right, values, table, bits)
        lefts.append(left[ok])
        rights.append(right[ok])

    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(SMALL, len(group))):
        at = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:]))
        if not len(at):
            break
        keep(at, at + lag)
    for a, n in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for k in range(a, a + n, 256):
            rows = np.arange(k, min(k + 256, a + n))
            left, right = np.divmod(np.arange(len(rows) * (a + n - k)), a + n - k)
            later = right > left
            left, right = k + left[later], k + right[later]
            ok = linked(left, right, values, table, bits)
            # a dense group has a link for most pairs; a spanning forest of each chunk is enough
            root = a + spanning_roots(n, left[ok] - a, right[ok] - a)
            at = a + np.flatnonzero(root != np.arange(a, a + n))
            lefts.append(at)
            rights.append(root[at - a])
    left = np.concatenate([np.zeros(0, np.int64), *lefts])
    right = np.concatenate([np.zeros(0, np.int64), *rights])
    root = spanning_roots(len(group), left, right)
    at = np.flatnonzero(root != np.arange(len(group)))
    return values[at].view(np.int64), values[root[at]].view(np.int64)


def _link_task(bits: int):
    """Rows come sorted by bucket and tile; the last, perhaps unfinished group waits."""

    def columns(batch: pa.RecordBatch):
        keys = np.stack([batch[k].to_numpy().astype(np.int64) for k in ("kind", "part", "low", "high")], 1)
        values = batch["node"].to_numpy().view(np.uint64)
        flat = np.asarray(batch["distances"].flatten()).reshape(len(values), -1)
        table = np.ascontiguousarray(flat).view(np.uint8).reshape(len(values), -1)
        return keys, values, table.astype(np.int8)

    def numbered(keys: np.ndarray) -> np.ndarray:
        new = np.any(keys[1:] != keys[:-1], axis=1)
        return np.concatenate([[0], np.cumsum(new)])

    def edges(keys, values, table) -> pa.RecordBatch:
        a, b = _link_groups(numbered(keys), values, table, bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            same = np.all(now[0] == now[0][-1], axis=1)
            cut = len(same) if not same.all() else 0
            cut = int(np.flatnonzero(~same)[-1]) + 1 if cut else 0
            if cut:
                yield edges(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None and len(held[0]):
            yield edges(*held)

    return task


def links(nodes: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Edges between distinct fingerprints (column node) that span what links connect."""
    buckets = nodes.select(
        "node",
        pivot_distances(F.col("node")).alias("distances"),
        F.posexplode(
            F.array(*(F.col("node").bitwiseAND(F.lit(m)) for m in bucket_masks(bits)))
        ).alias("kind", "part"),
    )
    sizes = common.stored(
        buckets.groupBy("kind", "part").agg(F.count("*").alias("n")).where("n > 1"), "buckets"
    )
    slices = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), slices)
    members = (
        buckets.join(sizes, ["kind", "part"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
        .where((F.col("n") <= tile) | (F.col("own") != F.col("other")))
        .select(
            "kind",
            "part",
            F.least("own", "other").cast("int").alias("low"),
            F.greatest("own", "other").cast("int").alias("high"),
            "node",
            "distances",
        )
    )
    key = ["kind", "part", "low", "high"]
    placed = members.repartition(*key).sortWithinPartitions(*key)
    return placed.mapInArrow(_link_task(bits), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    bits: int = BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    tile: int = TILE,
) -> DataFrame:
    """doc_id, text_hash, fingerprint (long) and component_id (least id reachable) per row."""
    marked = common.stored(fingerprints(docs, size, id_column, text_column), "fingerprints")
    nodes = common.stored(
        marked.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least")),
        "nodes",
    )
    edges = common.stored(links(nodes.select("node"), bits, tile).distinct(), "links")
    parts = connected_components(edges)
    joined = nodes.join(parts, "node", "left").select(
        "node", "least", F.coalesce("component", "node").alias("component")
    )
    heads = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    heads = common.stored(heads, "heads")
    named = common.stored(joined.join(heads, "component").select("node", "component", "component_id"), "named")
    return marked.join(named, marked["fingerprint"] == named["node"]).select(
        "doc_id", "text_hash", "fingerprint", "component_id", "component"
    )


def keep_one(
    docs: DataFrame,
    size: int = SHINGLE,
    bits: int = BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row of each component, with all its columns: that of the least id (rows without an id
    only where the component has no other), and of the least text hash among rows that share it."""
    return least_rows(docs, near_duplicates(docs, size, bits, id_column, text_column), id_column, text_column)


def least_rows(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of docs that `keep_one` keeps, given doc_id, text_hash and component of all rows."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("component").agg(F.min(order).alias("best"))
    winners = common.stored(
        best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash")), "winners"
    )
    again = common.stored(
        found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("_id", "_hash"),
        "repeated-rows",
    )
    own_hash = F.xxhash64(docs[text_column])

    def among(table: DataFrame) -> Column:
        return docs[id_column].eqNullSafe(table["_id"]) & (own_hash == table["_hash"])

    kept = docs.join(winners, among(winners), "left_semi")
    # of wholly repeated rows one stays; there are none in a table with a proper id
    single = kept.join(again, among(again), "left_anti")
    several = kept.join(again, among(again), "left_semi").dropDuplicates([id_column, text_column])
    return single.union(several)
