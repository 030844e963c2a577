import random
import re

import pytest
import xxhash

from cargoledger.llm import simhash


def plain_fingerprint(text, size=3):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(values, bits=3):
    """Every pair, then flood."""
    group = {}
    for v in values:
        if v in group:
            continue
        todo, seen = [v], {v}
        while todo:
            x = todo.pop()
            for y in values:
                if y not in seen and bin(x ^ y).count("1") <= bits:
                    seen.add(y)
                    todo.append(y)
        for x in seen:
            group[x] = min(seen)
    return group


def expected(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    group = plain_components({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[group[p]] = min(d, least.get(group[p], d))
    return sorted(((d, p, least.get(group[p])) for d, p in prints), key=repr)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    out = simhash.near_duplicates(frame, **how).select("doc_id", "fingerprint", "component_id").collect()
    return sorted(((r[0], r[1] % (1 << 64), r[2]) for r in out), key=repr)


def corpus():
    rng = random.Random(4)
    rows = []
    for d in range(40):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 200))]
        rows.append((d, " ".join(words)))
        if d % 3 == 0:
            for k in range(3):
                copy = list(words)
                copy[rng.randrange(len(copy))] = f"X{k}É"
                rows.append((100 + 10 * d + k, "\n".join(copy)))
    rows += [(500, None), (501, ""), (502, " \t"), (None, rows[0][1]), (None, "only here"), (7, "A b"), (503, "a B")]
    return rows + [rows[3], rows[3]]


def test_matches_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == expected(rows)


def test_large_buckets_are_cut_into_tiles(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    values |= {rng.getrandbits(64) for _ in range(40)}
    for tile in (20, 1000):
        nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "node long")
        edges = simhash.links(nodes, tile=tile).collect()
        assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 or tile for a, b in edges)
        parent = {v: v for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a % (1 << 64))] = root(b % (1 << 64))
        group = plain_components(values)
        assert {frozenset(v for v in values if root(v) == r) for r in map(root, values)} == {
            frozenset(v for v in values if group[v] == g) for g in group.values()
        }


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 40000])
def test_long_and_short_texts(n):
    words = [b"w%d" % (i % 977) for i in range(n)]
    if n < 1000:
        assert simhash.text_fingerprint(words) == plain_fingerprint(b" ".join(words).decode())
    else:
        assert simhash.text_fingerprint(words) == plain_fingerprint(b" ".join(words).decode())


def test_keep_one_row_of_each_component(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    groups = {}
    for (d, t), (_, p) in zip(rows, [(d, plain_fingerprint(t)) for d, t in rows]):
        groups.setdefault(p, []).append(d)
    component = plain_components(groups)
    out = [(r["doc_id"], component[plain_fingerprint(r["text"])]) for r in kept.collect()]
    assert sorted(c for _, c in out) == sorted(set(component.values()))
    for d, c in out:
        ids = [x for p, own in groups.items() if component[p] == c for x in own if x is not None]
        assert d == min(ids, default=None)
