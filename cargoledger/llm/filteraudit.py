"""How filters interact: every order of five filters, by wide packed counters.

A document's mask is the set of filters it fails. In a given order the first filter of the mask removes
it; all later ones find it gone. There are 120 orders of five steps, hence 600 step outcomes.

Method. `OUTCOMES` maps a mask to one big integer with a 64-bit field per step and outcome (kept after
the step, removed by it, failing it but removed before). Integers of the documents of a part are
summed: one addition counts all fields at once. A field holds up to 2**64 - 1 documents, more than a count of type
long can name, so none overflows into the next; after the sum the fields are unpacked. Sums over documents
of quality 1, and over toxic ones, give what is lost.

* One pass over the texts in Python finds the four measures of the text and its digest, with byte operations that
  run in C; a long text is cut at blanks into slices of `SLICE` bytes.
* Filter E compares texts across the whole table. Rows are counted by (digest, part, failed filters,
  labels) with the least id before and after the shuffle, so copies never meet in a task as rows: a hot text
  is one row per task, and there is no join of all rows with it.
* Equal masks are counted before they are multiplied and added, at most 128 per part.

Filters. A: under 50 words. B: fewer than 65 % of the words distinct. C: more than 5 % of the code points
are A-Z. D: any of `#$%&*|`. E: a smaller id in the table has the same text.

Rows. Null text: empty (fails A only; B and C compare zero with zero). Null part: the empty string. Rows
repeated with their id are counted each, and neither makes the other fail E. A row with a null id has no smaller id, is
smaller than none and has no labels. A document is good (toxic) if any of its label rows says 1.
Empty documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.llm import common
from cargoledger.llm.words import utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: Bits of a field: a sum of up to 2**64 - 1 documents cannot reach the next one.
WIDTH = 64
KINDS = ("kept", "removed", "redundant")
FIELDS = len(ORDERS) * len(FILTERS) * len(KINDS)
SLICE = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0D]")
_CONTINUE = bytes(range(0x80, 0xC0))
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: bytes) -> int:
    """Filters A to D that a text fails."""
    words, different, at = 0, set(), 0
    while at < len(text):
        end = _cut(text, at)
        found = text[at:end].split()  # at ASCII blanks, as bytes are split
        words += len(found)
        different.update(found)
        at = end
    points = len(text.translate(None, _CONTINUE))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        BIT["A"] * (words < LEAST_WORDS)
        | BIT["B"] * (100 * len(different) < DISTINCT_PERCENT * words)
        | BIT["C"] * (100 * capitals > CAPITAL_PERCENT * points)
        | BIT["D"] * any(s in text for s in SYMBOLS)
    )


def _cut(text: bytes, at: int) -> int:
    """End of a slice: behind `SLICE` bytes, where a word ends."""
    found = BLANK.search(text, at + SLICE)
    return found.start() if found else len(text)


def _mask_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = utf8(batch["text"])
        whole = memoryview(data)
        masks, digests = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = whole[a:b].tobytes()
            masks.append(text_mask(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
            ["doc_id", "part", "digest", "failed"],
        )


def failures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source"
) -> DataFrame:
    """doc_id, part, digest of the text, and the filters A to D that it fails, for every row."""
    part = F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col(id_column).alias("doc_id"), part, F.col(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_mask_task, f"doc_id {id_type}, part string, digest binary, failed int")


def masks(failed: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """part, mask, good, toxic and the number n of such documents; filter E included."""
    known = labels.select(F.col(id_column).alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    known = known.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = failed.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    rows = rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    with_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = common.stored(
        rows.groupBy("digest", "part", "failed", "good", "toxic").agg(
            F.min(with_id).alias("first"),  # the least id and its number of rows
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("without_id"),
            F.sum("n").alias("n"),
        ),
        "copies",
    )
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    is_first = F.col("first.doc_id") == F.col("least")
    spared = F.coalesce("without_id", F.lit(0)) + F.when(is_first, F.col("first.n")).otherwise(0)
    split = F.inline(
        F.array(
            F.struct(F.col("failed").alias("mask"), spared.alias("m")),
            F.struct((F.col("failed") + BIT["E"]).alias("mask"), (F.col("n") - spared).alias("m")),
        )
    )
    each = groups.join(least, "digest").select("part", "good", "toxic", split).where("m > 0")
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("m").alias("n"))


@lru_cache(maxsize=1)
def outcomes() -> list[int]:
    """For every mask the big integer of all its step outcomes."""
    out = []
    for mask in range(1 << len(FILTERS)):
        packed = 0
        for k, (order, step) in enumerate((o, s) for o in ORDERS for s in range(len(FILTERS))):
            fails = bool(mask & BIT[order[step]])
            before = any(mask & BIT[f] for f in order[:step])
            kept, removed, redundant = not before and not fails, fails and not before, fails and before
            for kind, holds in enumerate((kept, removed, redundant)):
                packed |= int(holds) << WIDTH * (len(KINDS) * k + kind)
        out.append(packed)
    return out


def unpack(packed: int) -> list[int]:
    """All fields of a sum, in order."""
    raw = packed.to_bytes(FIELDS * WIDTH // 8, "little")
    return [int.from_bytes(raw[i : i + WIDTH // 8], "little") for i in range(0, len(raw), WIDTH // 8)]


def _audit_part(table: pa.Table) -> pa.Table:
    """The 600 rows of a part from its counted masks."""
    every = good = toxic = 0
    alone = dict.fromkeys(FILTERS, 0)
    packed = outcomes()
    columns = (table[c].to_pylist() for c in ("mask", "good", "toxic", "n"))
    for mask, is_good, is_toxic, n in zip(*columns, strict=True):
        documents = n * packed[mask]
        every += documents
        good += documents * is_good
        toxic += documents * is_toxic
        for f in FILTERS:
            alone[f] += n * (mask == BIT[f])
    counts, lost_good, lost_toxic = unpack(every), unpack(good)[1::3], unpack(toxic)[1::3]
    kept, removed, redundant = counts[::3], counts[1::3], counts[2::3]
    steps = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
    shapley = dict.fromkeys(FILTERS, 0)
    for (order, step), n in zip(steps, removed, strict=True):
        shapley[order[step]] += n
    own = [order[step] for order, step in steps]
    return pa.table(
        {
            "part": [table["part"][0].as_py()] * len(steps),
            "filter_order": [order for order, _ in steps],
            "step": pa.array([step + 1 for _, step in steps], pa.int32()),
            "kept": kept,
            "removed": removed,
            "redundant": redundant,
            "unique_fails": [alone[f] for f in own],
            "good_lost": lost_good,
            "toxic_lost": lost_toxic,
            "shapley": [shapley[f] for f in own],
        }
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """A row per part, order of the filters and step, with the documents kept, removed and lost there."""
    failed = failures(docs, id_column, text_column, part_column)
    return masks(failed, labels, id_column).groupBy("part").applyInArrow(_audit_part, SCHEMA)
