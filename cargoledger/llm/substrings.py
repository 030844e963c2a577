"""Removal of passages that repeat across documents, by level-wise doubling.

A window is `window` consecutive words (runs of anything but ASCII blanks, unchanged) of one
document. Each word covered by a window whose word sequence also starts in a document with a
smaller id goes; windows are judged on the input, not on what is left.

Method. Start from windows of a seed length (eight words for fifty). Those that occur in
two documents or more are extended to twice their length, the last step to `window` itself, and
counted again; a window that is unique at one length is never extended. Longer windows than
`window` cannot change which words go, so the doubling ends there, or before, when no candidate
survives.

* Of the seed windows only anchors take part: within each span of `window` words, the seed window
  with the least hash. Equal spans have equal anchors at equal places, so nothing is lost, and
  about one position in twenty-two is shuffled instead of all.
* A document whose whole text also stands under a smaller id goes as a whole (if it has a window);
  its windows add nothing for others and are not compared. Whole texts are equal if 128 hash bits are.
* Windows are compared by 96 bits of two hashes of their words, and only (hash, id)
  pairs are shuffled, one per window and document; places are found again from the text.
* The least id per window is an aggregate that combines before the shuffle, and is stored, so the
  join back is one whose hot keys adaptive execution splits.
* What is gathered per document is a list no longer than the document.

Rows. Null text: no words. Null id: the row is kept whole and no window is compared with it. Rows
that share an id count as one document; each keeps its own text. Empty input gives empty output.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm import common
from cargoledger.llm.words import Block, blocks, run_hashes

WINDOW = 50
#: Doublings. The first length drops what shares no eight words with another document, each later one what shares no longer run.
LEVELS = 3


def level_lengths(window: int, levels: int) -> list[int]:
    """Seed length, its doubles, and `window` as the last: `levels` steps, from a power of two (50: 8, 16, 32, 50)."""
    length = max(1, (1 << (window - 1).bit_length()) >> levels)
    lengths = [length]
    while length < window:
        length = min(2 * length, window)
        lengths.append(length)
    return lengths


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in each run of `width` values, by doubling runs."""
    at, step = np.arange(len(values)), 1
    while 2 * step <= width:
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        step *= 2
    if step < width:
        left, right = at[: len(at) - (width - step)], at[width - step :]
        at = np.where(values[left] <= values[right], left, right)
    return at


def valid_starts(block: Block, length: int) -> np.ndarray:
    """Which words start a window of `length` words inside their own row."""
    n = block.first[-1]
    ok = np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int64)
    last = np.maximum(block.first[1:] - length + 1, block.first[:-1])
    np.add.at(delta, block.first[:-1], 1)
    np.add.at(delta, last, -1)
    np.greater(np.cumsum(delta[:-1]), 0, out=ok)
    return ok


def window_hashes(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, 64 and 32 bits, of every window of `length` words in a block."""
    one, two = run_hashes(block.word_hashes(), length)
    return one.view(np.int64), two.astype(np.uint32).view(np.int32)


def anchors_of(block: Block, hashes: np.ndarray, seed: int, window: int) -> np.ndarray:
    """Where the anchors of all windows start: in each, the first seed window of least hash."""
    if len(hashes) <= window - seed:
        return np.zeros(0, np.int64)
    at = first_least(hashes, window - seed + 1)
    at = at[valid_starts(block, window)[: len(at)]]
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _pairs(block: Block, batch: pa.RecordBatch, at: np.ndarray, **hashes) -> pa.RecordBatch:
    """Hashes of the windows that start at `at`, with their document, each once per row."""
    row = np.searchsorted(block.first, at, side="right") - 1
    order = np.lexsort((*(h[at] for h in reversed(hashes.values())), row))
    columns = [row[order], *(h[at][order] for h in hashes.values())]
    new = np.ones(len(at), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(c[new]) for c in columns[1:]),
            batch["doc_id"].take(pa.array(block.row + columns[0][new])),
        ],
        [*hashes, "doc_id"],
    )


def _members(block: Block, lists: pa.Array, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the windows at `at` whose hash is in their row's list."""
    lists = lists.slice(block.row, block.rows)
    offsets, listed = np.asarray(lists.offsets), np.asarray(lists.values)
    bounds = np.searchsorted(at, block.first)
    kept = [np.zeros(0, np.int64)]
    for r in np.flatnonzero(np.diff(offsets)):
        own = at[bounds[r] : bounds[r + 1]]
        kept.append(own[np.isin(hashes[own], listed[offsets[r] : offsets[r + 1]])])
    return np.concatenate(kept)


def _covered(block: Block, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which words lie up to `before` words ahead of a place or up to `after` behind it, in its
    own row."""
    row = np.searchsorted(block.first, at, side="right") - 1
    delta = np.zeros(block.first[-1] + 1, np.int64)
    np.add.at(delta, np.maximum(at - before, block.first[row]), 1)
    np.add.at(delta, np.minimum(at + after + 1, block.first[row + 1]), -1)
    return np.cumsum(delta[:-1]) > 0


def _anchor_task(seed: int, window: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                hashes, _ = window_hashes(block, seed)
                yield _pairs(block, batch, anchors_of(block, hashes, seed, window), one=hashes)

    return task


def _extension_task(seed: int, short: int, length: int, window: int) -> Callable:
    """Windows of `length` words that may repeat, given which shorter ones do.

    Around a repeated anchor, all that lie within a window holding it; later, those that begin
    and end with a repeated shorter window.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                known, _ = window_hashes(block, short)
                if short == seed:
                    at = anchors_of(block, known, seed, window)
                    at = _members(block, batch["hashes"], known, at)
                    wanted = _covered(block, at, window - seed, window - length)
                else:
                    at = np.flatnonzero(valid_starts(block, short))
                    wanted = np.zeros(block.first[-1], bool)
                    wanted[_members(block, batch["hashes"], known, at)] = True
                    wanted[: -(length - short)] &= wanted[length - short :]
                one, two = window_hashes(block, length)
                at = np.flatnonzero(wanted & valid_starts(block, length))
                yield _pairs(block, batch, at, one=one, two=two)

    return task


def _removal_task(window: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                hashes, _ = window_hashes(block, window)
                at = np.flatnonzero(valid_starts(block, window))
                at = _members(block, batch["hashes"], hashes, at)
                gone = _covered(block, at, 0, window - 1)
                counts = np.diff(block.first)
                copy = batch["copy"].slice(block.row, block.rows).to_numpy(zero_copy_only=False)
                gone |= np.repeat(copy & (counts >= window), counts)
                data, kept, removed = block.data.tobytes(), [], []
                for r in range(block.rows):
                    a, b = block.first[r], block.first[r + 1]
                    drop = gone[a:b]
                    n = int(drop.sum())
                    removed.append(n)
                    if n == b - a:
                        kept.append(b"")
                        continue
                    words = data[block.start[a] : block.end[b - 1]].split()
                    if n:
                        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(block.row, block.rows),
                        pa.array(counts),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return task


def _schema(kind: T.DataType, *hashes: tuple[str, T.DataType]) -> T.StructType:
    schema = T.StructType()
    for name, of in hashes:
        schema = schema.add(name, of)
    return schema.add("doc_id", kind)


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    levels: int = LEVELS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) per row."""
    texts = common.id_and_text(docs, id_column, text_column)
    named = texts.where(F.col("doc_id").isNotNull())
    kind = texts.schema["doc_id"].dataType
    lengths = level_lengths(window, levels)
    seed = lengths[0]

    copies = common.stored(_later_copies(named), "later-copies")
    pairs = named.mapInArrow(_anchor_task(seed, window), _schema(kind, ("one", T.LongType())))
    anchors_at = common.scratch_path(docs.sparkSession, "anchors")
    pairs = common.stored(pairs.join(copies, "doc_id", "left_anti"), "anchors", anchors_at, free=True)
    shared = _in_several(pairs, ["one"], "shared-anchors")
    hashes = _per_document(pairs.join(shared, "one"))
    hashes = common.stored(hashes, "anchors-by-document", free=True)
    common.remove(docs.sparkSession, anchors_at)

    for short, length in zip(lengths, lengths[1:], strict=False):
        pairs = named.join(hashes, "doc_id").mapInArrow(
            _extension_task(seed, short, length, window),
            _schema(kind, ("one", T.LongType()), ("two", T.IntegerType())),
        )
        shared = _in_several(pairs, ["one", "two"], f"shared-{length}")
        pairs = pairs.join(shared, ["one", "two"])
        if length == window:
            pairs = pairs.where(F.col("doc_id") > F.col("least"))
        hashes = common.stored(_per_document(pairs), f"hashes-{length}", free=True)
    none = F.array().cast("array<bigint>")
    marks = hashes.select("doc_id", "hashes", F.lit(False).alias("copy")).union(
        copies.select("doc_id", none, F.lit(True))
    )
    marked = named.join(marks, "doc_id", "left").select(
        "doc_id",
        "text",
        F.coalesce("hashes", none).alias("hashes"),
        F.coalesce("copy", F.lit(False)).alias("copy"),
    )
    marked = marked.union(
        texts.where(F.col("doc_id").isNull()).select("doc_id", "text", none, F.lit(False))
    )
    return marked.mapInArrow(
        _removal_task(window),
        T.StructType()
        .add("doc_id", kind)
        .add("n_words", T.LongType())
        .add("n_removed", T.LongType())
        .add("kept_text", T.StringType()),
    )


def _later_copies(texts: DataFrame) -> DataFrame:
    """Ids all of whose texts also stand, wholly equal, under a smaller id."""
    rows = texts.select(
        "doc_id",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit("second"), "text").alias("h2"),
    )
    heads = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    heads = common.stored(heads.where("n > 1").drop("n"), "copied-texts")
    return (
        rows.join(heads, ["h1", "h2"], "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False))).alias("copy"))
        .where("copy")
        .select("doc_id")
    )


def _in_several(pairs: DataFrame, key: list[str], name: str) -> DataFrame:
    """The windows that occur in two documents or more, with the least id that has them."""
    ends = pairs.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return common.stored(ends.where("least < most").drop("most"), name, free=True)


def _per_document(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id").agg(F.collect_list("one").alias("hashes"))
