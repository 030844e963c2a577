"""Quality rules as a short-circuit cascade, in built-in expressions only.

Words are runs of anything but ASCII blanks; lines are what `\\n` separates.

Method. Each rule is one condition on measures of the text. On a bounded sample
(`SAMPLE_ROWS` rows, drawn over the whole table) every rule is run by itself: the share it rejects
and the time it takes, less that of an empty pass, give rejections per second. The cascade is one
CASE expression in that order, so a row is only tested until a rule rejects it; a measure that no caller asked for is
worked out when its rule's turn comes. The order changes what is computed, never which rows are kept: a document
is kept if no rule rejects it.

Repeated five-word windows are compared by the 64-bit hash of their words, inside one text. Only
texts whose window hashes are not all distinct are sorted; nothing is exploded or shuffled.

Rows. Null text: no words, so it fails `few_words`. Ids are only carried, nulls and repeats
included. Empty input: no sample, the given order, empty output. Extra columns are ignored by
`judge`, and carried by `filter_documents`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.llm import common

SAMPLE_ROWS = 2000
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
REPEAT = 5
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A condition on measures under which a text is rejected; `needs` names the measures."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


#: Two rules every caller shares, then the operator's own.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)
OWN_RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
    Rule("capitals", ("n_capitals", "word_chars"), lambda c, n: 2 * c > n),
    Rule("digits", ("n_digits", "word_chars"), lambda c, n: 2 * c > n),
)
RULES = BASE_RULES + OWN_RULES


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that it names several times, computed once per row.

    A column of an earlier projection would not do: where the optimizer moves a filter below the
    projection, it writes the column's expression out at every place it is used.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(column: str | Column) -> Column:
    return F.coalesce(column, F.lit(""))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    nothing = F.array().cast("array<string>")
    return F.when(F.length(trimmed) == 0, nothing).otherwise(F.split(trimmed, BLANKS))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more in the list."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - REPEAT),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(REPEAT))),
    )
    return F.when(n < REPEAT, F.lit(0)).otherwise(bound(hashes, _covered))


def _covered(hashes: Column) -> Column:
    """Words covered by the windows of equal hash, by steps between their sorted places."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(
            p, lambda x, i: F.least(F.lit(REPEAT), F.coalesce(F.get(p, i + 1) - x, F.lit(REPEAT)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(distinct, F.lit(0)).otherwise(bound(bound(pairs, places), total))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Every measure as an expression of a text (not null) and its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
    }


def condition(rule: Rule, columns: dict[str, Column]) -> Column:
    return F.coalesce(rule.rejects(*(columns[m] for m in rule.needs)), F.lit(False))


def take_sample(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About `rows` texts drawn over the whole table, stored."""
    n = docs.count()
    texts = docs.select(text)
    if n > rows:
        texts = texts.sample(rows / n, seed=11)
    return common.stored(texts, "quality-sample")


def estimate(sample: DataFrame, text: str, rules: tuple[Rule, ...]) -> list[tuple[Rule, float, float]]:
    """Share rejected and seconds of each rule on the sample, the lesser of two runs."""

    def run(rule: Rule | None) -> tuple[float, float]:
        whole = text_of(F.col(text))
        rejects = bound(
            words_of(whole),
            lambda w: condition(rule, measures(whole, w)) if rule else F.size(w) < 0,
        )
        seconds = []
        for _ in range(2):
            start = time.perf_counter()
            row = sample.agg(F.avg(rejects.cast("int"))).first()
            seconds.append(time.perf_counter() - start)
        return row[0] or 0.0, min(seconds)

    _, idle = run(None)
    out = []
    for rule in rules:
        share, seconds = run(rule)
        out.append((rule, share, max(seconds - idle, 1e-3)))
    return out


def cascade_order(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS
) -> tuple[Rule, ...]:
    """The rules by rejections per second on the sample, most first."""
    sample = take_sample(docs, text, rows)
    ranked = sorted(estimate(sample, text, rules), key=lambda x: -x[1] / x[2])
    return tuple(rule for rule, _, _ in ranked)


def first_failed(order: tuple[Rule, ...], columns: dict[str, Column]) -> Column:
    """The first rule of the cascade that rejects the row; null if none does."""
    chain = F
    for rule in order:
        chain = chain.when(condition(rule, columns), F.lit(rule.name))
    return chain.otherwise(F.lit(None)) if order else F.lit(None).cast("string")


def filter_documents(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows that no rule rejects, with all their columns; measures are computed on demand."""
    order = cascade_order(docs, rules, text, rows)
    whole = text_of(docs[text])
    failed = bound(words_of(whole), lambda w: first_failed(order, measures(whole, w)))
    return docs.where(failed.isNull())


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, the measures `REPORTED`, base_failed, kept and failed_rule (the cascade's first) per row.

    Reported measures are of every row; all others are worked out inside the cascade, for the rows that come so far.
    """
    texts = common.id_and_text(docs, id_column, text_column)
    order = cascade_order(texts, rules, "text", rows)
    split = texts.select("doc_id", text_of("text").alias("text"))
    split = split.withColumn("words", words_of(F.col("text")))
    found = measures(F.col("text"), F.col("words"))
    measured = split.select("doc_id", "text", "words", *(found[n].alias(n) for n in REPORTED))
    columns = found | {n: F.col(n) for n in REPORTED}
    base = condition(BASE_RULES[0], columns) | condition(BASE_RULES[1], columns)
    judged = measured.select(
        "doc_id",
        *REPORTED,
        base.alias("base_failed"),
        first_failed(order, columns).alias("failed_rule"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
