"""Best-fit packing of documents into sequences, by hierarchical residual packing.

A document is its token ids followed by id 0. Longer ones than `capacity` are cut into pieces of
`capacity` ids, the last perhaps shorter; shorter ones stay whole.

Method. Texts are encoded in place, and one small row per piece is stored (id, length, checksum);
ids are not shuffled. Each partition packs its pieces best-fit, longest first. Bins that are nearly
full (at most `SPARE` free places) are final. The pieces of all others go, with their bin as one
item, to the next level, where `FAN_IN` partitions meet in one: underfull bins are items of a new
best-fit round. Bins that even the least filled one would overflow are final as well, so only what
can still be merged moves on. The tree ends with one partition, or once no two bins fit together.

* `FAN_IN` bounds how many residues meet; each is a bin of at most `capacity` tokens.
* Bin numbers come from partition numbers and are read back from the stored level, so a task that is
  run again cannot change what others have seen.

Rows. Null text: an empty one, so one piece of one id (0). Null and repeated ids are packed like
others; piece numbers run per row. Empty input gives empty output. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm import common
from cargoledger.llm.tokens import encoder, pieces_of

CAPACITY = 2048
SPARE = 8
FAN_IN = 8
END = 0


def _piece_task(path: str, capacity: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            for row, ids, offsets in pieces_of(texts, encoder(path)):
                rows, piece, start, length, crc = [], [], [], [], []
                for r in range(len(offsets) - 1):
                    own = np.append(ids[offsets[r] : offsets[r + 1]], np.uint32(END)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        rows.append(row + r)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return task


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row."""
    texts = common.id_and_text(docs, id_column, text_column)
    schema = (
        T.StructType()
        .add("doc_id", texts.schema["doc_id"].dataType)
        .add("piece", T.IntegerType())
        .add("start", T.LongType())
        .add("length", T.LongType())
        .add("ids_crc32", T.LongType())
    )
    return texts.mapInArrow(_piece_task(tokenizer, capacity), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its place in the bin, and each bin's fill; longest items first.

    Open bins are stacked by free places, and a bit set tells which stacks are not empty, so the
    tightest bin that still fits is the lowest set bit from the item's length on.
    """
    bins, place, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_ >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], place[i] = b, fill[b]
        fill[b] += n
        if left := free - n:
            if not stacks[left]:
                open_ |= 1 << left
            stacks[left].append(b)
    return bins, place, np.array(fill, np.int64)


PACKED = ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill")


def _pack_task(capacity: int, level: int):
    """One partition: whole bins of the level before are the items (each piece its own at first)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        item, first, number = np.unique(
            np.asarray(table["bin"]), return_index=True, return_inverse=True
        )
        bins, place, fill = best_fit(np.asarray(table["fill"])[first], capacity)
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        own = bins[number]
        columns = {n: table[n] for n in table.column_names}
        columns["bin"] = pa.array(base + own)
        columns["offset"] = pa.array(np.asarray(table["offset"]) + place[number])
        columns["fill"] = pa.array(fill[own])
        yield from pa.table(columns).select(PACKED).to_batches(max_chunksize=10_000)

    return task


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    spare: int = SPARE,
    fan_in: int = FAN_IN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    cut = common.stored(pieces(docs, tokenizer, capacity, id_column, text_column), "pieces")
    # every piece is a bin of its own; full ones need no packing
    rows = cut.select(
        "*",
        F.monotonically_increasing_id().alias("bin"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("fill"),
    )
    rows = common.stored(rows, "level-0")
    schema = rows.select(*PACKED).schema
    spark = docs.sparkSession
    final = [rows.where(F.col("fill") >= capacity - spare)]
    left = rows.where(F.col("fill") < capacity - spare)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level = 1
    while True:
        dealt = left.select(*PACKED).repartition(parts, _group(parts, level))
        packed = common.stored(dealt.mapInArrow(_pack_task(capacity, level), schema), f"level-{level}")
        largest = _largest_item(packed, capacity, spare)
        if parts == 1 or largest is None:
            final.append(packed)
            break
        final.append(packed.where(F.col("fill") > largest))
        left = packed.where(F.col("fill") <= largest)
        parts = -(-parts // fan_in)
        level += 1
    out = final[0].select(*PACKED)
    for more in final[1:]:
        out = out.union(more.select(*PACKED))
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.col("bin").alias("sequence_id"),
        "offset",
    )


def _group(parts: int, level: int):
    """First pieces are dealt evenly, then whole bins by the partition they come from."""
    return F.xxhash64("bin") if level == 1 else F.pmod(F.shiftright("bin", 32), F.lit(parts))


def _largest_item(packed: DataFrame, capacity: int, spare: int) -> int | None:
    """The fill up to which a bin could still be merged with another; None if no two fit.

    Nearly full bins are final, and so are those that even the least filled bin would overflow.
    """
    bins = packed.groupBy("bin").agg(F.max("fill").alias("fill"))
    least = [r["fill"] for r in bins.orderBy("fill").limit(2).collect()]
    if len(least) < 2 or sum(least) > capacity:
        return None
    return min(capacity - spare - 1, capacity - least[0])
