import numpy as np
import pytest

from cargoledger.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, g int, ids string"


def brute(rows, every):
    """The definition, row by row, in Python integers."""
    good = [
        (i, lab, [int(np.floor(256 * x)) for x in v])
        for i, lab, v in rows
        if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, a_label, a_vector in (r for r in good if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(a_vector, v, strict=False)), i, lab) for i, lab, v in good)
        positives = [(s, i) for s, i, lab in scored if lab == a_label and i != a][:5]
        for ps, p in positives:
            found = [(s, i) for s, i, lab in scored if lab != a_label and -80 * ps <= -100 * s <= -100 * ps][:5]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def result(spark, rows, every=10):
    return sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), every).collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (64, 64, 64), (65, 33, 127), (100, 0, 40), (0, 8, 3), (130, 70, 260)])
def test_strassen_equals_plain_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()
    assert (negatives.strassen(a << 40, b << 12, leaf=4) == ((a @ b) << 52)).all()  # sums that wrap stay exact modulo 2**64


def test_equals_definition(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)  # several anchor blocks
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(4)), rng.normal(0.2, 0.3, 9).tolist()) for i in range(-40, 400)]
    got = result(spark, rows)
    assert got == brute(rows, 10) and len(got) > 500


def test_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 2, (4, 6)).astype(float).tolist()
    rows = [(i, i % 3, kinds[i % 4]) for i in range(300)]
    assert result(spark, rows) == brute(rows, 10)
    again = [r for r in rows if r[0] % 10] * 2 + [r for r in rows if r[0] % 10 == 0]
    assert result(spark, again) == brute(again, 10)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 2, [0.5, i / 100]) for i in range(60)]
    rows += [
        (None, 1, [1.0, 1.0]), (100, None, [1.0, 1.0]), (101, 1, None), (102, 1, [1.0, None]),
        (103, 0, [nan, 1.0]), (104, 0, [1.0, inf]), (110, 0, [-inf, 0.0]), (120, 1, []), (130, 0, [0.5]), (131, 1, [0.5, 0.2, 0.7]),
    ]
    assert result(spark, rows) == brute(rows, 10)


def test_negative_and_empty_windows(spark):
    rows = [(0, 0, [1.0]), (1, 0, [-1.0]), (2, 1, [-1.0]), (3, 0, [0.0]), (4, 1, [0.0]), (10, 5, [1.0])]
    assert result(spark, rows) == brute(rows, 10) == [(0, 3, 1, 4, 0, 0)]
    assert result(spark, []) == []
    assert result(spark, [(1, 0, [1.0])]) == []


def test_windows_without_overflow():
    p = np.array([10, 7, -3, 0, 2**61, negatives.NONE])
    least, most = negatives.windows(p)
    for k, score in enumerate(p[:-1].tolist()):
        holds = [n for n in range(score - 4, score + 2) if 80 * score <= 100 * n <= 100 * score]
        assert [n for n in range(score - 4, score + 2) if least[k] <= n <= most[k]] == holds
    assert least[-1] > most[-1]


def test_merging_is_associative():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 9, (20, 30)), rng.permutation(600).reshape(20, 30)
    scores[:, ::7] = negatives.NONE
    whole = negatives.merged(scores, ids, 5)
    left = negatives.merged(scores[:, :11], ids[:, :11], 5)
    right = negatives.merged(scores[:, 11:], ids[:, 11:], 5)
    both = negatives.merged(np.hstack([right[0], left[0]]), np.hstack([right[1], left[1]]), 5)
    assert (both[0] == whole[0]).all() and (both[1] == whole[1])[whole[0] != negatives.NONE].all()


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="2\\*\\*62"):
        result(spark, [(0, 0, [1e300]), (1, 0, [1.0])])


def test_labels_of_every_seventh_row(spark):
    rows = frame(spark, [(7, 9, []), (14, None, []), (8, 9, []), (21, 2**31 - 1, [])])
    got = [r["label"] for r in negatives.relabelled(rows).collect()]
    assert got == [0, None, 9, 2**31 % 10]
