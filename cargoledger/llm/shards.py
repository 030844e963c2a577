"""Balanced label propagation: documents into shards of equal counts, linked ones together.

Equal texts are one node (a group). Nodes are linked by the long lines they share (`LINE` code points or more, trimmed), held as
memberships (line, node), never as pairs. The law is `rows`: shard sizes in rows differ by at most one.

Method. Groups of more than a quarter of a shard are laid out first, one behind the other over as few shards as hold them, and stay.
Every other node starts in a shard drawn by its hash from the space left. In each round the memberships are joined with the labels of their
nodes; a line votes for the shard that holds most of its rows (on a tie one drawn by hash), with the part of its rows that are
there, and a node wants the shard with most votes. A shard takes in no more rows than its quota leaves (the mean size plus `SLACK`): nodes
that want it come in the order of a hash drawn anew each round, in `DRAWS` buckets, as many buckets as have room. Rounds go on while the
cut (the sum over lines of the part of their rows outside their main shard) falls by `LEAST` or more; the best labels count.
Last, sizes are made equal: shards with too many rows hand their last ones to shards with too few. Rows are ordered by kind (large groups,
linked nodes and groups, single documents) and node, so single documents go first and each hand-over splits at most one
group; all other rows stay where the rounds put them.

* The texts are read once, for ids, hashes and lines; rounds work on the memberships of lines that two nodes or more share.
* Votes combine before the shuffle, and are stored, so that joins back can be split at a hot line. Numbers are ranks
  within fine buckets plus the sizes of the buckets before, so neither a hot group nor the whole table is sorted in one task.
* The driver sees one row per shard and draw bucket, nothing that grows with the documents.

Built-in expressions and joins only. Rows: null text counts as an empty one of size 1 (equal to
other nulls and to empty texts); null and repeated ids are rows like any other, with the tie
between wholly equal rows broken arbitrarily, as they cannot be told apart. Empty input gives empty
output. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoledger.llm import common

SHARDS = 16
LINE = 40
SLACK = 0.1
#: A round that lowers the cut by a smaller part than this is the last.
LEAST = 0.01
DRAWS = 1024
#: Buckets of the numbering: per shard, by group hash, and within a large group by document hash.
BUCKETS = 512
SPLITS = 64
LARGE, LINKED, SINGLE = 0, 1, 2


def memberships(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, a 128-bit group (g1, g2) and the hashes of the long lines per row."""
    texts = common.id_and_text(docs, id_column, text_column)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.length(x) >= LINE)
    return texts.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit("second"), text).alias("g2"),
        F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"),
    )


def _share(*columns) -> Column:
    """A number in [0, 1) drawn from the columns."""
    return F.pmod(F.xxhash64(F.lit("share"), *columns), F.lit(1 << 20)) / F.lit(float(1 << 20))


def repeated_groups(members: DataFrame, shards: int, total: int) -> DataFrame:
    """g1, g2, rows of every group of two rows or more; `before` is set for large ones only: the rows of large ones ahead."""
    counts = members.groupBy("g1", "g2").agg(F.count("*").alias("rows")).where("rows > 1")
    counts = common.stored(counts, "groups")
    # at most 4 * shards of them
    large = counts.where(F.col("rows") * 4 * shards > total)
    ahead = F.sum("rows").over(Window.orderBy(F.desc("rows"), "g1", "g2")) - F.col("rows")
    large = common.stored(large.select("g1", "g2", ahead.alias("before")), "large-groups")
    return common.stored(counts.join(large, ["g1", "g2"], "left"), "repeated-groups")


def shared_lines(members: DataFrame, groups: DataFrame) -> DataFrame:
    """line, g1, g2, rows: nodes of every line that two nodes or more hold; large groups take no part."""
    held = members.select("g1", "g2", F.explode("lines").alias("line")).distinct()
    held = common.stored(held.join(groups.where("before is not null"), ["g1", "g2"], "left_anti"), "held-lines")
    several = common.stored(held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "lines")
    sizes = groups.select("g1", "g2", "rows")
    linked = held.join(several, "line").join(sizes, ["g1", "g2"], "left")
    return common.stored(linked.withColumn("rows", F.coalesce("rows", F.lit(1))), "shared-lines")


def votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """line, main, weight (part of its rows in its main shard)."""
    placed = edges.join(labels.select("g1", "g2", "shard"), ["g1", "g2"])
    counts = placed.groupBy("line", "shard").agg(F.sum("rows").alias("n"))
    best = F.max(F.struct("n", F.xxhash64("line", "shard").alias("drawn"), "shard")).alias("best")
    lines = counts.groupBy("line").agg(F.sum("n").alias("rows"), best)
    return common.stored(
        lines.select("line", F.col("best.shard").alias("main"), ((F.lit(1_000_000) * F.col("best.n")).cast("long") / F.col("rows")).cast("long").alias("weight")),
        "votes",
    )


def propagate(edges: DataFrame, labels: DataFrame, others: list[int], shards: int, rounds: int | None = None) -> DataFrame:
    """Labels (g1, g2, rows, shard) after the rounds; `others` are the rows per shard that do not move."""
    quota = None
    best, least, done = labels, None, 0
    while True:
        told = votes(edges, labels)
        cut = told.agg(F.sum(F.lit(1_000_000) - F.col("weight"))).first()[0] or 0
        if least is not None and cut >= least:
            break
        enough = least is not None and cut > least * (1 - LEAST)
        best, least = labels, cut
        if enough or not cut or done == rounds:
            break
        done += 1
        load = list(others)
        for r in labels.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
            load[r["shard"]] += r["n"]
        quota = quota or sum(load) / shards * (1 + SLACK)
        sums = edges.join(told, "line").groupBy("g1", "g2", "main").agg(F.sum("weight").alias("votes"))
        wanted = sums.groupBy("g1", "g2").agg(
            F.max(F.struct("votes", F.xxhash64("g1", "g2", "main").alias("drawn"), "main"))["main"].alias("main")
        )
        wanting = common.stored(
            labels.join(wanted, ["g1", "g2"], "left")
            .withColumn("wants", F.when(F.col("main") != F.col("shard"), F.col("main")))
            .withColumn("draw", F.pmod(F.xxhash64(F.lit(done), "g1", "g2"), F.lit(DRAWS)).cast("int"))
            .drop("main"),
            "wanting",
        )
        asked = wanting.where("wants is not null").groupBy("wants", "draw").agg(F.sum("rows").alias("n")).collect()
        # of every shard: the first draw bucket that has no room left
        first = []
        for s in range(shards):
            queue = sorted((r["draw"], r["n"]) for r in asked if r["wants"] == s)
            filled = accumulate(n for _, n in queue)
            full = (d for (d, _), n in zip(queue, filled, strict=True) if load[s] + n > quota)
            first.append(next(full, DRAWS))
        admitted = F.col("draw") < F.element_at(F.array(*map(F.lit, first)), F.col("wants") + 1)
        shard = F.when(F.col("wants").isNotNull() & admitted, F.col("wants")).otherwise(F.col("shard"))
        labels = common.stored(wanting.select("g1", "g2", "rows", shard.alias("shard")), "labels")
    return best


def numbered(rows: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """Adds `number`, gapless from 0, by the bucket columns `order`, then by `within`.

    Ranks are taken inside buckets; a table with one row per bucket gives what stands before each.
    """
    sizes = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*order)) - F.col("_n")
    starts = common.stored(sizes.withColumn("_before", before).drop("_n"), "bucket-starts")
    rank = F.row_number().over(Window.partitionBy(*order).orderBy(*within)) - 1
    ranked = rows.withColumn("_rank", rank).join(starts, order)
    return ranked.withColumn("number", F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def started(members: DataFrame, groups: DataFrame, shards: int, total: int) -> DataFrame:
    """Adds the group's rows and rank among large ones, piece and the first shard of every row."""
    piece = F.when(F.col("before").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS)).cast("int"))
    joined = members.drop("lines").join(groups, ["g1", "g2"], "left").withColumn("piece", F.coalesce(piece, F.lit(0)))
    joined = common.stored(joined, "joined")
    # the shards that the large groups fill are full to the row
    large = numbered(joined.where("before is not null"), ["before", "piece"], ["doc_id"])
    at = F.expr(f"(number * {shards}L) div {max(total, 1)}L").cast("int")
    rest = joined.where("before is null").withColumn("shard", F.lit(None).cast("int"))
    rows = common.stored(large.withColumn("shard", at).select(*rest.columns).union(rest), "rows")
    free = [total / shards] * shards
    for r in rows.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect():
        free[r["shard"]] = max(0.0, free[r["shard"]] - r["n"])
    bounds = list(accumulate(free))
    drawn = _share("g1", "g2") * (bounds[-1] or 1.0)
    passed = sum((F.when(drawn >= b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    return rows.withColumn("shard", F.coalesce("shard", passed.cast("int")))


def equalised(rows: DataFrame, shards: int) -> DataFrame:
    """Shards of equal counts, and slots: the last rows of shards with too many go to those with too few."""
    order = numbered(rows, ["shard", "kind", "bucket", "part", "piece"], ["g1", "g2", "doc_id"])
    counts, laid = [0] * shards, [0] * shards
    of_large = F.count_if(F.col("kind") == LARGE).alias("laid")
    for r in rows.groupBy("shard").agg(F.count("*").alias("n"), of_large).collect():
        counts[r["shard"]], laid[r["shard"]] = r["n"], r["laid"]
    low, more = divmod(sum(counts), shards)
    # the odd rows go to shards that large groups fill, then to the fullest
    fullest = sorted(range(shards), key=lambda s: (laid[s] <= low, -counts[s], s))[:more]
    size = [low + (s in fullest) for s in range(shards)]
    begin = [0, *accumulate(counts)][:-1]
    over = [max(0, c - w) for c, w in zip(counts, size, strict=True)]
    over_before = [0, *accumulate(over)][:-1]
    short = [max(0, w - c) for c, w in zip(counts, size, strict=True)]
    short_before = [0, *accumulate(short)][:-1]

    def of(values: list[int], shard: Column) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard + 1)

    place = F.col("number") - of(begin, F.col("shard"))
    given = place - of(size, F.col("shard"))  # from 0 for rows handed over
    nth = of(over_before, F.col("shard")) + given
    told = order.withColumn("_place", place).withColumn("_nth", F.when(given >= 0, nth))
    takes = sum((F.when(F.col("_nth") >= b + n, 1).otherwise(0) for b, n in zip(short_before, short, strict=True)), F.lit(0))
    target = F.when(F.col("_nth").isNotNull(), takes)
    told = told.withColumn("_target", target.cast("int"))
    slot = F.when(F.col("_nth").isNull(), F.col("_place")).otherwise(
        of(counts, F.col("_target")) + F.col("_nth") - of(short_before, F.col("_target"))
    )
    return told.withColumn("slot", slot.cast("long")).withColumn("shard", F.coalesce("_target", "shard")).drop("_place", "_nth", "_target")


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    rounds: int | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row; `rounds` may end propagation early."""
    members = common.stored(memberships(docs, id_column, text_column), "members")
    total = members.count()
    groups = repeated_groups(members, shards, total)
    edges = shared_lines(members, groups)
    rows = common.stored(started(members, groups, shards, total), "started")
    nodes = edges.select("g1", "g2").distinct()
    start = rows.join(nodes, ["g1", "g2"], "left_semi").groupBy("g1", "g2").agg(F.count("*").alias("rows"), F.min("shard").alias("shard"))
    start = common.stored(start, "labels")
    others = [0] * shards
    for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect():
        others[r["shard"]] += r["n"]
    for r in start.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
        others[r["shard"]] -= r["n"]
    labels = propagate(edges, start, others, shards, rounds)
    moved = rows.join(labels.select("g1", "g2", F.col("shard").alias("label")), ["g1", "g2"], "left")
    large, many = F.col("before").isNotNull(), F.col("rows").isNotNull() | F.col("label").isNotNull()
    placed = moved.select(
        "doc_id",
        "size",
        "text_crc32",
        "g1",
        "g2",
        "piece",
        F.coalesce("label", "shard").alias("shard"),
        F.when(large, LARGE).when(many, LINKED).otherwise(SINGLE).alias("kind"),
        F.pmod(F.xxhash64("g1", "g2"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        # 0 for the small groups of a bucket; the large ones stand one after the other
        F.when(large, F.col("g1")).otherwise(F.lit(0)).alias("part"),
    )
    return equalised(common.stored(placed, "placed"), shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
