import hashlib
import random
import re

import pytest

from cargoledger.llm import substrings

SCHEMA = "doc_id long, text string, n_words string, places string"


def brute(rows, window):
    """Every window of every document in a dictionary."""
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(d, t, "x", None) for d, t in rows], SCHEMA)
    kept = substrings.remove_repeats(frame, **how).collect()
    return sorted(
        ((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in kept), key=repr
    )


@pytest.mark.parametrize(("window", "levels"), [(8, 1), (8, 2), (7, 2), (50, 1), (50, 3)])
def test_matches_brute_force(spark, window, levels):
    rng = random.Random(window * 10 + levels)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(90)] for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"own{d}-{rng.randrange(99)}" for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a = rng.randrange(60)
            words += p[a : a + rng.randrange(5, 80)]
        if d % 9 == 0:
            words += ["the"] * rng.randrange(120)
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(None, rows[3][1]), (70, None), (71, ""), (72, " \n "), (5, rows[9][1]), (9, rows[9][1])]
    rows += [(80, "é x " * 200), (81, "é x " * 180)]
    assert found(spark, rows, window=window, levels=levels) == brute(rows, window)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_lengths_double():
    assert substrings.level_lengths(50, 3) == [8, 16, 32, 50]
    assert substrings.level_lengths(8, 2) == [2, 4, 8] and substrings.level_lengths(7, 1) == [4, 7]
    assert substrings.level_lengths(1, 3) == [1]
