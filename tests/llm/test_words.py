import random

import numpy as np
import pyarrow as pa

from cargoledger.llm import substrings, tokens, words
from test_packing import ids_of


def thue_morse(levels, a, b):
    """A word and its complement, which any polynomial hash modulo 2**64 confuses from 512 letters on."""
    one, two = a, b
    for _ in range(levels):
        one, two = one + two, two + one
    return one, two


def hashes(texts):
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    return words.byte_hash(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def test_regular_words_are_told_apart():
    for levels in range(1, 13):
        one, two = hashes(thue_morse(levels, "a", "b"))
        assert one != two
    runs = [r for k in range(1, 8) for r in thue_morse(k, ["x"], ["y"])]
    for run, other in zip(runs[::2], runs[1::2], strict=True):
        both = [words.run_hashes(hashes(r), len(r)) for r in (run, other)]
        assert both[0][0] != both[1][0] and both[0][1] != both[1][1]


def test_equal_spans_have_equal_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abé", k=rng.randrange(0, 150))) for _ in range(500)] + ["a" * n for n in range(150)]
    got = hashes(texts)
    alone = [hashes([t])[0] for t in texts]
    assert got.tolist() == alone
    assert len(set(alone)) == len(set(texts))


def test_runs():
    rng = random.Random(2)
    letters = rng.choices("abc", k=3000)
    for length in (1, 2, 3, 5, 8, 25, 50):
        one, two = words.run_hashes(hashes(letters), length)
        runs = ["".join(letters[i : i + length]) for i in range(len(letters) - length + 1)]
        assert len(one) == len(two) == len(runs)
        assert len(set(one.tolist())) == len(set(two.tolist())) == len(set(runs))
        assert len(set(zip(one.tolist(), runs, strict=True))) == len(set(runs))
    assert len(words.run_hash(hashes(["a"]), 5)) == 0


def test_same_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.randrange(0, 200))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    length = np.minimum(ends - starts, np.roll(ends - starts, 1))
    got = words.same_bytes(data, starts, data, np.roll(starts, 1), length)
    assert got.tolist() == [t[:n] == u[:n] for t, u, n in zip(texts, np.roll(texts, 1), length.tolist(), strict=True)]
    assert words.same_bytes(data, starts, data, starts, ends - starts).all()


def test_long_words_keep_their_documents(spark):
    one, two = thue_morse(11, "a", "b")
    same = [f"w{k}" for k in range(49)]
    rows = [(1, " ".join([*same, one])), (2, " ".join([*same, two])), (3, " ".join([*same, one]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 50}


def test_long_words_keep_their_ids(spark, monkeypatch):
    one, two = thue_morse(11, "a", "b")
    texts = [one, two, f"{one} {two}", "Plain WORDS and plain words, 12 éa ÉA"]
    path = str(__import__("public_tokenizers").path("word_bpe_49k.json"))

    def encoded():
        ids, offsets = tokens.ChunkEncoder(path).encode(pa.array(texts))
        return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]

    want = [list(ids_of(t)) for t in texts]
    assert encoded() == want
    # even if hashes were to clash all the time
    monkeypatch.setattr(tokens, "byte_hash", lambda *spans: words.byte_hash(*spans) % np.uint64(3))
    assert encoded() == want
