import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargoledger.llm import common, tokencounts

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "   ", "a", " a ", "a▁b", "▁", "▁▁ a", "</s><s><unk> <|endoftext|>", "\x00\t\n\r b", "\U0001f600́ é",
    "x" * 3000, "word " * 30000, " " * 70000 + "a" + " " * 70000, "a  b" * 20000 + " ", "same", "same",
]


def frame(spark, texts):
    rows = [(None if i % 5 == 4 else i // 2, t, b"clash", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest binary, n_tokens int")


def random_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["the ", " token", "  ", "\n", "é", "ß ", "▁", "漢字", "12345", "<s>", "\t", "Zq", ". ", "　", "ﬁ", "'s"]
    return ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(n)]


def by_library(path):
    if path == PIECES:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t or ""))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [PIECES, WORDS])
def test_counts_are_the_library_s(spark, path):
    count, texts = by_library(path), TEXTS + random_texts(200) + TEXTS
    docs = frame(spark, texts)
    got = tokencounts.count_tokens(docs, common.scratch_path(spark, "tc"), path, limit=20)
    got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect())
    want = sorted(
        (repr(r["doc_id"]), len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 20) for r in docs.collect()
    )
    assert got == want


def test_parts_of_long_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert tokencounts.cuts_at_spaces(model)
    for text in TEXTS[1:] + random_texts(300, 6):
        text = text.replace("▁", " ")
        for size in (1, 3, 17):
            cut = list(tokencounts.parts(text, size))
            assert " ".join(cut) == text
            assert sum(len(model.encode(p)) for p in cut) == len(model.encode(text))


def test_only_misses_are_encoded_and_appended(spark):
    folder = common.scratch_path(spark, "tc")
    first, more = frame(spark, ["a", "b", "b", None, ""]), frame(spark, ["b", "c▁d", "c d", "c d", "a", " "])
    version = tokencounts.tokenizer_version(PIECES)

    def stored():
        return spark.read.parquet(f"{folder}/{version}").count()

    assert tokencounts.update_cache(first, folder, PIECES)[1] == 3 and stored() == 3
    assert tokencounts.update_cache(first, folder, PIECES)[1] == 0 and stored() == 3
    assert tokencounts.update_cache(more, folder, PIECES)[1] == 2 and stored() == 5
    # what is stored is used: a changed count shows
    cached = tokencounts.read_cache(first, folder, version).withColumn("n_tokens", F.lit(77).cast("long"))
    other = common.scratch_path(spark, "tc")
    cached.write.parquet(f"{other}/{version}")
    rows = tokencounts.count_tokens(first, other, PIECES).collect()
    assert [r["n_tokens"] for r in rows] == [77] * 5
    # another version has counts of its own
    assert tokencounts.update_cache(first, folder, WORDS)[1] == 3


def test_rows_repeated_as_a_whole_are_encoded_once(spark):
    docs = spark.createDataFrame([(1, "again and again")] * 500 + [(None, "none")] * 500, "doc_id long, text string").repartition(4)
    folder = common.scratch_path(spark, "tc")
    assert tokencounts.count_tokens(docs, folder, PIECES).count() == 1000
    assert tokencounts.update_cache(docs, folder, PIECES)[1] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokencounts.count_tokens(docs, common.scratch_path(spark, "tc"), PIECES).collect() == []


def test_query_counts_in_two_versions(spark, monkeypatch):
    from cargoledger.llm import queries

    calls, update = [], tokencounts.update_cache

    def counted(*args, **more):
        rows, n = update(*args, **more)
        calls.append((rows.count(), rows.select("digest").distinct().count(), n))
        return rows, n

    monkeypatch.setattr(tokencounts, "update_cache", counted)
    queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect()
    (half, half_texts, first), (every, texts, second) = calls
    assert first == half_texts and second == texts - half_texts and half < every
