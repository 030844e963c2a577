import random
import re
from collections import Counter

from cargoledger.llm import filteraudit

DOCS = "doc_id long, text string, source string, part string, good int, n long"
LABELS = "doc_id long, quality int, toxic int, part string"


def definition(docs, labels):
    """Row by row, order by order."""
    fails = []
    for i, text, source, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs),
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        good, toxic = any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)
        fails.append((source or "", {f for f in bad if bad[f]}, good, toxic))
    out = {}
    for part in {f[0] for f in fails}:
        removed_by = Counter()
        for order in filteraudit.ORDERS:
            alive = [f for f in fails if f[0] == part]
            for step, own in enumerate(order, 1):
                here = [f for f in alive if own in f[1]]
                alive = [f for f in alive if own not in f[1]]
                failing = [f for f in fails if f[0] == part and own in f[1]]
                removed_by[own] += len(here)
                out[part, order, step] = [
                    len(alive), len(here), len(failing) - len(here), sum(f[1] == {own} for f in failing),
                    sum(f[2] for f in here), sum(f[3] for f in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(spark, docs, labels):
    rows = filteraudit.audit(
        spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    ).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_equals_definition(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "A", "#", "é" * 99 + "A" * 5, "é" * 94 + "A" * 5, " x" * 60, "AB|" * 70]
    for _ in range(60):
        chosen = rng.choices(words[: rng.choice([20, 60, 400])], k=rng.choice([10, 49, 50, 90]))
        chosen += rng.choices(["#", "UPPERCASE", "&x", "\x0b", "é"], k=rng.choice([0, 0, 1, 9]))
        texts.append(rng.choice([" ", "\n", "  "]).join(chosen))
    docs = []
    for _ in range(400):
        i = rng.choice([None, *range(300)])
        docs.append((i, rng.choice(texts), rng.choice([None, "", "a", "b"]), "clash", 5, 6))
    docs += docs[:30]
    labels = [(rng.choice([None, *range(300)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), "clash") for _ in range(200)]
    got = result(spark, docs, labels)
    assert got == definition(docs, labels)
    assert set(k[0] for k in got) == {"", "a", "b"} and len(got) == 3 * 600


def test_empty_tables(spark):
    assert result(spark, [], []) == {}
    one = result(spark, [(1, "x", None, "", 1, 1)], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_long_texts_in_slices(monkeypatch):
    text = ("Ab é " * 300 + "#\v" + "q" * 500 + "\n").encode()
    whole = filteraudit.text_mask(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(filteraudit, "SLICE", size)
        assert filteraudit.text_mask(text) == whole


def test_fields_hold_their_counts_apart():
    packed = filteraudit.outcomes()
    n = 2**59  # 32 masks of so many documents each fill a field without running over
    fields = filteraudit.unpack(sum(n * p for p in packed))
    assert sum(fields) == n * sum(p.bit_count() for p in packed)
    assert max(fields) < 2**filteraudit.WIDTH
    one = filteraudit.unpack(packed[filteraudit.BIT["A"] | filteraudit.BIT["C"]])
    order = filteraudit.ORDERS.index("BCADE") * 15
    assert one[order : order + 15] == [1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
