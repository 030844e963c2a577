import zlib
from collections import Counter, defaultdict

import pytest

from cargoledger.llm import shards


def run(spark, rows, n=4, **how):
    frame = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, size long")
    return shards.assign(frame, shards=n, **how).collect()


def outside(out, rows):
    """Brute force: per shared long line the part of its rows outside its main shard, summed; and texts in two shards."""
    text, lines, texts = dict(rows), defaultdict(Counter), defaultdict(set)
    for r in out:
        texts[text[r["doc_id"]]].add(r["shard"])
        for line in {x.strip() for x in (text[r["doc_id"]] or "").split("\n") if len(x.strip()) >= shards.LINE}:
            lines[line][r["shard"]] += 1
    return sum(1 - max(c.values()) / c.total() for c in lines.values()), sum(len(s) > 1 for s in texts.values())


def check_law(out, rows, n):
    assert len(out) == len(rows)
    sizes = Counter(r["shard"] for r in out)
    counts = [sizes.get(s, 0) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    for s in range(n):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    given = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == given


def test_groups_stay_together(spark):
    rows = [(i, f"own {i}") for i in range(1200)]
    rows += [(2000 + 10 * g + k, f"group {g}") for g in range(80) for k in range(2 + g % 4)]
    out = run(spark, rows)
    check_law(out, rows, 4)
    text = dict(rows)
    where = defaultdict(set)
    for r in out:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 12


@pytest.mark.parametrize("n", [1, 16])
def test_hot_group_nulls_and_repeats(spark, n):
    rows = [(i, "hot É") for i in range(400)] + [(i, f"t{i}") for i in range(400, 900)]
    rows += [(None, None), (None, ""), (5, "hot É"), (901, None), (901, None)]
    check_law(run(spark, rows, n), rows, n)


@pytest.mark.parametrize("hot", [0, 3000])
def test_each_cut_splits_one_group(spark, hot):
    n = 16
    rows = [(i, "hot") for i in range(hot)]
    rows += [(10000 + i, f"pair {i // 2}") for i in range(3600)] + [(20000 + i, f"five {i // 5}") for i in range(1200)]
    rows += [(30000 + i, f"own {i}") for i in range(1200)]
    out = run(spark, rows, n)
    check_law(out, rows, n)
    text = dict(rows)
    where = defaultdict(set)
    for r in out:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") <= n - 1
    assert not hot or len(where["hot"]) <= hot * n // len(rows) + 2


def test_empty_and_tiny_tables(spark):
    assert run(spark, []) == []
    check_law(run(spark, [(1, "a"), (2, "a"), (3, None)], 16), [(1, "a"), (2, "a"), (3, None)], 16)


def test_rounds_bring_linked_documents_together(spark):
    n = 8
    chain = [f"line {k} that is shared by documents of one family, long enough" for k in range(700)]
    rows = [(10 * f + k, f"{chain[f]}\nown {f} {k}\n{chain[f]}") for f in range(150) for k in range(2 + f % 5)]
    rows += [(5000 + f, f"{chain[2 * f]}\n{chain[2 * f + 1]}") for f in range(60)]  # links between families
    rows += [(6000 + k, f"{chain[k]} same") for k in range(300, 500) for _ in range(1)]
    rows += [(7000 + k, f"{chain[k // 2 + 300]} same") for k in range(400)]  # copies of the ones before
    rows += [(9000 + k, f"single {k}") for k in range(300)]
    before = run(spark, rows, n, rounds=0)
    after = run(spark, rows, n)
    check_law(before, rows, n)
    check_law(after, rows, n)
    (cut0, split0), (cut1, split1) = outside(before, rows), outside(after, rows)
    assert cut1 < 0.25 * cut0
    assert split0 <= n - 1 and split1 <= n - 1


def test_one_line_in_most_documents(spark):
    line = "a line that a third of all documents and more hold, long enough to link"
    rows = [(k, f"{line}\n{k}") for k in range(900)] + [(1000 + k, f"own {k}") for k in range(300)]
    check_law(run(spark, rows, 8), rows, 8)
