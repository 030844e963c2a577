import random

import numpy as np
from pyspark.sql import functions as F

from cargoledger.llm import latent

DOCS = "doc_id long, text string, item int"


def vocabulary(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n)]


def world(items=30, docs=250):
    rng = random.Random(6)
    words = vocabulary(rng, 5000)
    draw = lambda k: [words[int(5000 ** rng.random()) - 1] for _ in range(k)]
    bench = [(i, " ".join(draw(rng.randrange(15, 60))) + ". " + " ".join(draw(6)) + ".") for i in range(items)]
    bench += [(1000, " ".join(draw(220)) + "."), (1001, None), (1002, " . ")]
    texts, planted = [], set()
    for d in range(docs):
        own = draw(rng.randrange(400))
        if d % 4 == 0:
            i = rng.randrange(items + 1)
            passage = bench[i][1].split()
            if d % 8 == 0:  # a paraphrase: some words changed, put in and left out
                for _ in range(len(passage) // 12):
                    passage[rng.randrange(len(passage) - 8)] = rng.choice(words)
                passage.insert(3, "inserted")
                del passage[5]
            at = rng.randrange(len(own) + 1)
            own = own[:at] + [w.upper() for w in passage] + own[at:]
            planted.add((d, bench[i][0]))
        texts.append((d, " ".join(own)))
    return bench, texts, planted


def found(spark, texts, bench, **columns):
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts], DOCS)
    items = spark.createDataFrame(bench, "item_id long, text string")
    return latent.find_leaks(docs, items).collect()


def test_planted_passages_are_found_and_others_left_alone(spark):
    bench, texts, planted = world()
    rows = found(spark, texts, bench)
    got = {(r["doc_id"], r["item"]) for r in rows}
    assert planted <= got
    # brute force: every benchmark passage against every window of every document
    lists = dict(zip([d for d, _ in texts], latent.word_lists([t for _, t in texts])))
    table = latent.benchmark_passages(spark.createDataFrame(bench, "item_id long, text string"))
    item_of = {r["key"]: r["item"] for r in table.collect()}
    passages = latent.read_passages(table)
    want = set()
    for d, words in lists.items():
        for k in range(0, max(len(words), 1), latent.CELL):
            region = words[max(k - latent.CELL, 0) : k + latent.PASSAGE + latent.CELL]
            want |= {(d, item_of[p.key]) for p in passages if latent.verify(p, region)[0]}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_nulls_repeats_and_empty_tables(spark):
    bench, texts, planted = world(10, 60)
    d, item = min(planted)
    text = dict(texts)[d]
    extra = [(None, text), (500, None), (501, ""), (d, text), (d, "other text"), (502, "word " * 5000 + text)]
    got = [(r["doc_id"], r["item"]) for r in found(spark, texts + extra, bench)]
    assert (None, item) in got and (502, item) in got and got.count((d, item)) == 2
    assert found(spark, [], bench) == [] and found(spark, texts[:5], []) == []
    docs = spark.createDataFrame([(a, t, 1) for a, t in texts + extra], DOCS)
    kept = latent.remove_leaks(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (d, "other text") in left and (500, None) in left and (None, text) not in left and (d, text) not in left


def test_a_leak_in_a_third_of_the_rows_is_found(spark):
    bench, texts, _ = world(10, 90)
    leak = bench[3][1]
    texts = [(d, f"{t} {leak}" if d % 3 == 1 else t) for d, t in texts]
    got = {(r["doc_id"], r["item"]) for r in found(spark, texts, bench)}
    assert {(d, 3) for d, _ in texts if d % 3 == 1} <= got
    # a few short documents with the same leak
    few = [(d, f"document {d} {leak}") for d in range(6)]
    assert {(r["doc_id"], r["item"]) for r in found(spark, few, bench)} == {(d, 3) for d, _ in few}


def test_an_item_of_frequent_words_is_found(spark):
    bench, texts, _ = world(10, 90)
    rng = random.Random(8)
    frequent = [f"often{k}" for k in range(12)]
    item = " ".join(rng.choices(frequent, k=50))
    texts = [(d, " ".join([t, *rng.choices(frequent, k=60)])) for d, t in texts]
    held = [(1000 + d, f"{t} {item} {t}") for d, t in texts[:5]]
    got = {(r["doc_id"], r["item"]) for r in found(spark, texts + held, [*bench, (77, item)])}
    assert {(d, 77) for d, _ in held} <= got


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert latent.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def test_paraphrases_by_words_of_the_same_contexts_are_found(spark):
    """Telling words replaced by others of their contexts: far apart as TF-IDF rows, close in the latent space."""
    rng = random.Random(11)
    plain = [f"plain{k}" for k in range(15)]
    topics = [([f"one{k}x{i}" for i in range(16)], [f"two{k}x{i}" for i in range(16)]) for k in range(60)]
    texts = []
    for d in range(960):
        one, two = topics[d % 60]
        texts.append((d, " ".join(rng.choices(plain, k=60) + rng.choices(one + two, k=56))))
    bench, planted = [], set()
    for i in range(120):
        one, two = topics[i % 60]
        kept, told = rng.choices(plain, k=17), rng.sample(range(16), 15)
        mixed = lambda words: [w for k in range(17) for w in ([kept[k], words[told[k]]] if k < 15 else [kept[k]])]
        answer = " ".join(rng.choices(plain, k=6))
        bench.append((i, " ".join(mixed(one)) + ". " + answer + "."))
        if i % 2:
            planted.add((1000 + i, i))
            texts.append((1000 + i, " ".join(mixed(two)) + " " + answer))
    got = {(r["doc_id"], r["item"]) for r in found(spark, texts, bench)}
    assert len(planted & got) >= 0.9 * len(planted)
    # plain TF-IDF leaves most of them below the threshold
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    weights = latent.term_weights(docs)
    table = latent.benchmark_passages(spark.createDataFrame(bench, "item_id long, text string"))
    assert latent.latent_basis(docs.withColumn("text_hash", docs.doc_id), table, weights).shape[1] <= len(bench) // 2

    def row(text):
        out = np.zeros(latent.BUCKETS)
        np.add.at(out, latent.buckets_of(latent.word_lists([text])[0]), 1)
        out *= weights
        return out / np.linalg.norm(out)

    by_id, items = dict(texts), dict(bench)
    missed = {(d, i) for d, i in planted if row(by_id[d]) @ row(items[i]) < latent.COSINE}
    assert len(missed) > 0.7 * len(planted) and len(missed & got) >= 0.9 * len(missed)


def test_what_is_skipped_could_not_be_verified():
    """The counts of rare words leave every window that verifies, whatever the weights."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(40)]
    texts, passages = [], []
    for k in range(12):
        item = rng.choices(words, k=rng.choice([1, 3, 10, 40, 64]))
        own, answer = latent.word_lists([" ".join(item), " ".join(item[-3:])])
        passages.append(latent.Passage(k, own, answer))
        for _ in range(6):
            held = [w for w in item if rng.random() < 0.9]
            texts.append(" ".join(rng.choices(words, k=rng.randrange(200)) + held + rng.choices(words, k=rng.randrange(90))))
    weights = np.random.default_rng(1).random(latent.BUCKETS).astype(np.float32) + 1
    search = latent.Search(passages, weights, np.ones((latent.BUCKETS, 1), np.float32))
    n = 0
    for block in latent.blocks(latent.pa.array(texts), latent.NOT_ALPHANUMERIC, lower=True):
        hashes = block.word_hashes()
        cell, first = latent.cells_of(block)
        kept = set(zip(*(x.tolist() for x in search.windows(hashes, cell, int(first[-1]))), strict=True))
        for row in range(block.rows):
            for c in range(first[row], first[row + 1]):
                start, end = block.first[row] + (c - first[row]) * latent.CELL, block.first[row + 1]
                region = hashes[max(start - latent.CELL, block.first[row]) : min(start + latent.PASSAGE + latent.CELL, end)]
                for q, passage in enumerate(passages):
                    if latent.verify(passage, region)[0]:
                        n += 1
                        assert (c, q) in kept
    assert n > 50


def test_blocks_of_passages_and_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(latent, "ITEMS", 7)
    bench, texts, planted = world(20, 60)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(float(i), t, "ignored") for i, t in bench], "item_id double, text string, answer string")
    rows = latent.find_leaks(docs, items.selectExpr("cast(item_id as decimal(9,1)) as item_id", "text", "answer")).collect()
    assert planted <= {(r["doc_id"], int(r["item"])) for r in rows}


def test_the_basis_is_fitted_on_every_row(spark, monkeypatch):
    """The energy of the rows that are fitted is that of the whole table, however large."""
    sums, added = [], latent._added
    monkeypatch.setattr(latent, "_added", lambda *a: sums.append(added(*a)) or sums[-1])
    n, texts = 45_000, [f"one{k} one{k} two{k % 7}" for k in range(100)]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("doc_id") % 100 + 1).cast("int"))
    docs = spark.range(n).toDF("doc_id").withColumn("text", text)
    weights = np.random.default_rng(2).random(latent.BUCKETS).astype(np.float32) + 1
    passages = latent.benchmark_passages(spark.createDataFrame([(1, texts[3])], "item_id long, text string"))
    latent.latent_basis(docs, passages, weights)
    rows = [np.bincount(latent.buckets_of(words), minlength=latent.BUCKETS) * weights for words in latent.word_lists(texts)]
    want = sum(float((row.astype(float) ** 2).sum()) for row in rows) * n / len(texts)
    assert abs(sums[0][1] - want) < 1e-4 * want and abs(sums[1][1] - 1) < 1e-4


def test_the_sketch_equals_that_of_the_whole_matrix(monkeypatch):
    monkeypatch.setattr(latent, "GATHERED", 7)
    monkeypatch.setattr(latent, "PIECE", 4)
    rng = np.random.default_rng(3)
    weights = rng.random(latent.BUCKETS).astype(np.float32) + 1
    term, row = rng.integers(0, 30, 500), np.sort(rng.integers(0, 60, 500))
    dense = np.zeros((60, latent.BUCKETS))
    np.add.at(dense, (row, term), weights[term])
    for unit in (False, True):
        sketch = latent.Sketch(weights, 5)
        sketch.add(term[:0], row[:0], unit)
        for part in (row < 20, row >= 20):
            sketch.add(term[part], row[part], unit)
        rows = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9) if unit else dense
        want = rows.T @ (rows @ latent.random_matrix(5))
        assert np.allclose(sketch.total, want, rtol=1e-4, atol=1e-3) and np.isclose(sketch.energy, (rows**2).sum(), rtol=1e-5)
