"""Secret scans over an incremental blob ledger.

Texts are addressed by the SHA-256 of their UTF-8 bytes: every version of every path that has the same
content is one blob. The ledger holds, per blob, which rules (with their versions) have looked at it,
and what they found. A run scans only pairs of blob and rule version that the ledger lacks, adds
them, and joins the findings back to all paths.

Rules `assign`, `access` and `hex` are the base: matches are leftmost and do not overlap within a
kind, and those that are too short are dropped. The other kinds are added by this operator. A span
is that of the whole match, in code points, end exclusive.

* A row per blob, not per copy, is scanned: the copy with the least id. Ids, not texts, are
  aggregated to find it. One join by id brings in the texts, so a hot blob cannot fill a task.
* A cheap linear-time search over a batch tells which texts can match a rule at all; only those go
  to the exact expression.
* Findings come back by blob; the ledger is a stored table, so hot blobs are split by adaptive
  execution. A ledger grows by appended folders, one per run; nothing in it is rewritten.

Rows. Null text: empty. Null ids are paths like any other. Repeated rows stay. Empty input gives an
empty result and an empty ledger. Extra columns are ignored by `findings`, and carried by `redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.llm import common


@dataclass(frozen=True)
class Rule:
    """`hint` (linear-time syntax) holds wherever `pattern` has a match that counts."""

    kind: str
    version: int
    hint: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


KEYS = r"(password|passwd|secret|token|api_?key)"
BASE_RULES = (
    Rule(
        "assign", 1, rf"(?i){KEYS}[\"']?\x20*[:=]",
        rf"(?ai:{KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32),
)
HEADER, FOOTER = (rf"-----{word} [A-Z\x20]{{0,40}}PRIVATE KEY-----" for word in ("BEGIN", "END"))
#: A line break, as such or escaped as in JSON.
BREAK = r"(?:[\r\n]|\\[rn])"
#: The key body with its footer, or, where that is missing, all body characters and line breaks; before
#: it perhaps the fields of an encrypted key. Nothing is tried twice, so time is linear.
BODY = (
    rf"(?:(?:\s|{BREAK})*+(?:Proc-Type|DEK-Info):(?:(?!{BREAK}).)*+)*+"
    rf"(?:(?:[A-Za-z0-9+/=\s]|{BREAK})*+{FOOTER}"
    rf"|(?:[\x20\t]*+{BREAK}[\x20\t]*+)*[A-Za-z0-9+/=]++(?:(?:[\x20\t]*+{BREAK}[\x20\t]*+)++[A-Za-z0-9+/=]++)*+)?"
)
OWN_RULES = (
    Rule("pem", 2, HEADER, HEADER + BODY),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10}", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + OWN_RULES
FOUND = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"
MASK = "[secret]"


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Spans that count, leftmost first."""
    found = re.finditer(rule.pattern, text)
    return [m.span() for m in found if len(m[rule.group]) >= rule.least]


def address(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every path with its blob."""
    return common.id_and_text(docs, id_column, text_column).select("doc_id", _blob("text").alias("blob"))


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, the rules that have not looked at it (todo), and the least id that has it."""
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    every = F.array(*(F.lit(r.name) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    none = F.array().cast("array<string>")
    todo = F.array_except(every, F.coalesce("seen", none))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).drop("seen").where(F.size("todo") > 0)


def _scan_task(rules: tuple[Rule, ...]):
    ranks = {r.kind: k for k, r in enumerate(rules)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            todo = batch["todo"].to_pylist()
            found = [[] for _ in todo]
            for rule in rules:
                for r in np.flatnonzero(pc.match_substring_regex(texts, rule.hint)).tolist():
                    if rule.name in todo[r]:
                        for start, end in matches(rule, texts[r].as_py()):
                            found[r].append(
                                {"start": start, "rank": ranks[rule.kind], "kind": rule.kind, "end": end}
                            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch["blob"],
                    batch["todo"],
                    pa.array(
                        found,
                        pa.list_(
                            pa.struct(
                                [("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]
                            )
                        ),
                    ),
                ],
                ["blob", "rules", "found"],
            )

    return task


def scan(
    docs: DataFrame,
    paths: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """New ledger rows: one per blob with a rule that had not looked at it."""
    todo = common.stored(unseen(paths, ledger, rules), "unseen")
    texts = common.id_and_text(docs, id_column, text_column).withColumn("blob", _blob("text"))
    with_id = texts.where(F.col("doc_id").isNotNull()).join(
        todo.where(F.col("doc_id").isNotNull()), ["doc_id", "blob"]
    )
    # blobs that only rows without an id have
    without = texts.where(F.col("doc_id").isNull()).drop("doc_id").dropDuplicates(["blob"])
    without = without.join(todo.where(F.col("doc_id").isNull()).drop("doc_id"), "blob")
    chosen = with_id.select("blob", "text", "todo").union(without.select("blob", "text", "todo"))
    return chosen.mapInArrow(_scan_task(rules), LEDGER)


def update_ledger(
    docs: DataFrame,
    folder: str,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger in a folder lacks and append it; returns (paths, ledger)."""
    spark = docs.sparkSession
    paths = common.stored(address(docs, id_column, text_column), "paths")
    known = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known)
    ledger = spark.read.schema(LEDGER).parquet(folder) if exists else None
    scan(docs, paths, ledger, rules, id_column, text_column).write.mode("append").parquet(folder)
    return paths, spark.read.schema(LEDGER).parquet(folder)


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with findings of the present rule versions: all of them, by start, then kind."""
    current = F.array(*(F.lit(r.name) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    rows = ledger.where((F.size("found") > 0) & F.arrays_overlap("rules", current))
    own = F.filter(
        "found",
        lambda x: F.exists(
            F.arrays_zip(kinds.alias("kind"), current.alias("name")),
            lambda k: (k["kind"] == x["kind"]) & F.array_contains("rules", k["name"]),
        ),
    )
    rows = rows.select("blob", own.alias("found"))
    merged = rows.groupBy("blob").agg(F.flatten(F.collect_set("found")).alias("found"))
    return merged.withColumn("found", F.array_sort(F.array_distinct("found")))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, found for every path, spans or none."""
    hits = common.stored(by_blob(ledger, rules), "findings")
    return paths.join(hits, "blob", "left").select(
        "doc_id", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")
    )


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced; overlapping spans become one mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, x: Column) -> Column:
        fresh = x["start"] >= done["at"]
        before = F.substring(text, done["at"] + 1, x["start"] - done["at"])
        return F.struct(
            F.when(fresh, F.concat(done["out"], before, F.lit(MASK))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], x["end"]).alias("at"),
        )

    return F.aggregate(
        found, start, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))
    )


def redact(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """All rows and columns, secrets in the text masked."""
    _, ledger = update_ledger(docs, folder, rules, text_column=text_column)
    hits = common.stored(by_blob(ledger, rules), "findings")
    whole = docs.select(F.struct("*").alias("_row"), _blob(text_column).alias("_blob"))
    hits = hits.select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    joined = whole.join(hits, "_blob", "left")
    text = F.col(f"_row.{text_column}")
    clean = F.when(F.col("_found").isNull(), text).otherwise(masked(text, F.col("_found")))
    row = F.col("_row").withField(text_column, clean)
    return joined.select(row.alias("_row")).select("_row.*")
