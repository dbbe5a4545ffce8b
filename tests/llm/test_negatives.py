import math
import random

import numpy as np
import pytest

from roomledger.llm import negatives

ROW = "vec_id bigint, embedding array<float>, label int, i int, score string"


def expected(rows, every=100):
    """From all pairs."""
    sound = {}
    for key, vector, label, *_ in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in vector])
        sound[key] = min(sound.get(key, own), own)
    out = []
    for anchor, (label, v) in sound.items():
        if anchor % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w, strict=True)), key, of)
            for key, (of, w) in sound.items() if key != anchor and len(w) == len(v)
        )
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus]
            out += [(anchor, positive, n, s[1], -minus, -s[0]) for n, s in enumerate(inside[:10], 1)]
    return sorted(out)


def vectors(seed, n, length=6, ties=False):
    rng = random.Random(seed)
    pick = (lambda: rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0])) if ties else (lambda: float(np.float32(rng.gauss(0.3, 0.5))))
    return [(i, [pick() for _ in range(length)], rng.choice([0, 0, 0, 1, 2, 9]), 0, "x") for i in range(n)]


@pytest.mark.parametrize("ties", (False, True))
def test_same_rows_as_from_all_pairs(spark, ties, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = vectors(1, 400, ties=ties)
    frame = spark.createDataFrame(rows, ROW)
    got = sorted(map(tuple, negatives.hard_negatives(spark, frame, every=20).collect()))
    assert got and got == expected(rows, 20)


def test_odd_rows(spark):
    rows = vectors(2, 150)
    rows += [(None, [1.0] * 6, 1, 0, "x"), (700, None, 1, 0, "x"), (701, [1.0] * 6, None, 0, "x")]
    rows += [(702, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 0, "x"), (703, [math.nan] + [1.0] * 5, 1, 0, "x")]
    rows += [(704, [math.inf] + [1.0] * 5, 1, 0, "x"), (800, [], 1, 0, "x"), (801, [], 2, 0, "x"), (802, [], 1, 0, "x")]
    rows += [(900 + i, [0.5, 0.25 * i], i % 3, 0, "x") for i in range(40)]  # another length
    rows += [rows[100], (0, [2.0] * 6, 3, 0, "x"), (100, [0.1] * 6, rows[100][2], 0, "x")]  # repeated ids
    frame = spark.createDataFrame(rows, ROW)
    got = sorted(map(tuple, negatives.hard_negatives(spark, frame).collect()))
    assert got == expected(rows)
    assert negatives.hard_negatives(spark, frame.limit(0)).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = vectors(3, 200)
    rows += [(1000 + i, [0.5] * 6, i % 4, 0, "x") for i in range(100)]
    frame = spark.createDataFrame(rows, ROW)
    assert sorted(map(tuple, negatives.hard_negatives(spark, frame).collect())) == expected(rows)


def test_scores_are_exact():
    rng = np.random.default_rng(4)
    for top in (1 << 10, 1 << 27, 1 << 29):
        a, b = rng.integers(-top, top, (3, 7)), rng.integers(-top, top, (5, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert negatives.scores(a, b).tolist() == want
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_windows_of_positives_at_and_below_zero():
    pairs = [((1, 0, False, 9), None), ((1, 0, True, 3), None), ((1, 5, False, 4), None), ((1, 5, True, 2), None)]
    assert list(negatives.mined(iter(pairs))) == [(1, 9, 1, 3, 0, 0)]
