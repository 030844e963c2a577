import random
import re

import corpus_pipeline
from test_packing import ids_of
from test_quality import plain as quality_of
from test_secrets import base_spans
from test_simhash import plain_components, plain_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(4000)]
    draw = lambda k: [words[int(4000 ** rng.random()) - 1] for _ in range(k)]
    bench = [(i, " ".join(draw(40))) for i in range(8)]
    rows = []
    for d in range(120):
        own = draw(rng.randrange(12, 200))
        if d % 10 == 1:
            own += bench[d % 8][1].split()
        if d % 10 == 2:
            own.append('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')
        if d % 10 == 3:
            own = [w + "%%%" for w in own]
        if d % 10 == 4:
            own = own[:3]
        rows.append((d, " ".join(own)))
    rows += [(200 + d, t) for d, t in rows[::6]] + [(300, None), (301, ""), (302, "Der " * 100)]
    return rows, bench


def test_stages_against_brute_force(spark, tmp_path):
    rows, bench = corpus()
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.dtypes == spark.createDataFrame([], COLUMNS).dtypes
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after.append(docs.collect())
    left = [(d, t) for d, t in rows if quality_of(t)[-1]]
    assert sorted(r["doc_id"] for r in after[0]) == sorted(d for d, _ in left)
    prints = {d: plain_fingerprint(t) for d, t in left}
    group = plain_components(set(prints.values()))
    least = {}
    for d in sorted(prints):
        least.setdefault(group[prints[d]], d)
    left = [(d, t) for d, t in left if least[group[prints[d]]] == d]
    assert sorted(r["doc_id"] for r in after[1]) == sorted(d for d, _ in left)
    left = [(d, t) for d, t in left if not any(b in t for _, b in bench)]
    assert sorted(r["doc_id"] for r in after[2]) == sorted(d for d, _ in left)
    masked = {r["doc_id"]: r["text"] for r in after[3]}
    for d, t in left:
        assert masked[d] == (re.sub(r'token = "[0-9a-f]+', "[secret]", t) if base_spans(t) else t)
    assert all(r["n_chars"] == len(r["text"]) for r in after[3])
    assert sum(r["length"] for r in after[4]) == sum(len(ids_of(t)) + 1 for t in masked.values())


def test_run_applies_all_stages(spark, tmp_path):
    rows, bench = corpus()
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in packed}
    assert 0 in ids and not ids & {1, 3, 4, 300, 301, 302}
