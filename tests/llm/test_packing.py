import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cargoledger.llm import packing
from cargoledger.llm.tokens import ChunkEncoder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\u2003'sAÉé\u0301<|endoftext|>1")), max_size=40), max_size=6))
def test_chunks_encode_like_whole_texts(texts):
    ids, offsets = ChunkEncoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(t) for t in texts]


def run(spark, rows, **how):
    frame = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, bin long")
    return packing.pack(frame, PATH, **how).collect()


def check_packing(out, rows, capacity):
    expected = []
    for d, t in rows:
        ids = np.array(ids_of(t) + [0], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected.append((d, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(x[3] for x in expected)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_pieces_and_bins(spark, fan_in):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "of", "Énxq", "42"], k=int(rng.expovariate(1 / 30))))) for i in range(500)]
    rows += [(None, None), (3, "a b"), (3, "a b"), (600, ""), (601, "word " * 900)]
    bins, total = check_packing(run(spark, rows, capacity=128, fan_in=fan_in), rows, 128)
    assert bins <= -(-total // 128) * 1.03 + 1


def test_large_items_end_the_tree(spark):
    rows = [(i, "the " * 79) for i in range(60)]
    bins, _ = check_packing(run(spark, rows, capacity=128), rows, 128)
    assert bins == 60


def test_empty_table(spark):
    assert run(spark, []) == []


def test_best_fit_takes_the_tightest_bin():
    bins, place, fill = packing.best_fit(np.array([60, 50, 40, 38, 10]), 100)
    assert bins.tolist() == [0, 1, 0, 1, 1] and fill.tolist() == [100, 98] and place.tolist() == [0, 0, 60, 50, 88]
