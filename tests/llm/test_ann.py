import numpy as np

from roomledger.llm import ann

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, list int"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "k", 1) for i, v in vectors]
    return spark.createDataFrame(rows, VECTORS)


def brute(vectors, every=50):
    good = {i: np.asarray(v, np.float32).astype(float) for i, v in vectors}
    ids = np.array(sorted(good))
    matrix = np.array([good[i] for i in ids])
    norm = np.linalg.norm(matrix, axis=1)
    out = {}
    for q in ids[ids % every == 0]:
        score = matrix @ good[q] / (norm * np.linalg.norm(good[q]))
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:5]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 60)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    vectors = list(enumerate(rng.standard_normal((1500, 40))))
    got, want = found(ann.nearest(spark, frame(spark, vectors))), brute(vectors)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    scores = {q: dict(pairs) for q, pairs in brute_all(vectors, got).items()}
    for q, pairs in got.items():
        assert len(pairs) == 5
        assert all(abs(scores[q][i] - s) < 1e-12 for i, s in pairs)


def brute_all(vectors, queries):
    good = {i: np.asarray(v, np.float32).astype(float) for i, v in vectors}
    return {
        q: [(i, float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q])))) for i, v in good.items()] for q in queries
    }


def test_equal_vectors_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (30, 8)).astype(float) + 0.5
    vectors = [(i, base[0] if i % 3 == 0 else base[i % 30]) for i in range(200)]
    bad = [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] + [0.0] * 6), (1150, [float("nan")] + [1.0] * 7), (1200, []),
           (None, base[1]), (1250, [1.0, 2.0])]
    got = found(ann.nearest(spark, frame(spark, [*vectors, *bad, vectors[0], vectors[7]])))
    want = brute(vectors)
    assert {q: [i for i, _ in pairs] for q, pairs in got.items()} == {q: [i for i, _ in pairs] for q, pairs in want.items()}


def test_few_and_no_rows(spark):
    assert ann.nearest(spark, frame(spark, [])).count() == 0
    assert ann.nearest(spark, frame(spark, [(0, [1.0, 0.0])])).count() == 0
    got = found(ann.nearest(spark, frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [2.0, 0.0])])))
    assert [i for i, _ in got[0]] == [50, 1] and [i for i, _ in got[50]] == [0, 1]


def test_lone_queries_get_all_their_rows(spark, monkeypatch):
    """Queries far from all clusters: their nearest vectors lie in many lists, most of them not scanned."""
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    vectors = list(enumerate(centres[np.arange(2000) % 40] + 0.05 * rng.standard_normal((2000, 32))))
    lone = {50 * i: rng.standard_normal(32) for i in range(0, 40, 4)}
    vectors = [(i, lone.get(i, v)) for i, v in vectors]
    got, want = found(ann.nearest(spark, frame(spark, vectors))), brute(vectors)
    assert {q: len(pairs) for q, pairs in got.items()} == dict.fromkeys(want, 5)
    scores = brute_all(vectors, got)
    for q, pairs in got.items():
        assert all(abs(dict(scores[q])[i] - s) < 1e-12 for i, s in pairs)


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rng = np.random.default_rng(6)
    long = [(i, rng.standard_normal(8)) for i in range(60)]
    short = [(i, rng.standard_normal(4)) for i in range(100, 120)]
    got = found(ann.nearest(spark, frame(spark, [*long, *short, (200, [1.0]), (150, [-2.0]), (151, [3.0])])))
    want = brute(long) | brute(short)
    assert {q: [i for i, _ in got[q]] for q in want} == {q: [i for i, _ in pairs] for q, pairs in want.items()}
    assert [i for i, _ in got[200]] == [151, 150] and [i for i, _ in got[150]] == [151, 200]


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    columns = [np.ascontiguousarray(x[:, a : a + 16]) for a in range(0, 64, 16)]
    hits = seen = 0
    for q in x[:50]:
        kept = ann.scan(q, columns, 4.1, 6)
        hits += len(set(np.argsort(-(x @ q))[:6]) & set(kept))
        seen += len(kept)
    assert hits >= 0.98 * 300 and seen < 50 * 60
