import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomledger.llm import graph, near


def shingles(text, words):
    found = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def closed(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def expected(pairs, words, percent):
    sets = {i: shingles(t, words) for i, t in pairs}
    ids = [i for i in sets if sets[i]]
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[:n]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = closed(links, list(sets))
    return sorted((i, len(sets[i]), root[i], i == root[i]) for i in sets)


def copies(seed=1, groups=12, per_group=14):
    """Groups of texts that differ in a few words, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(per_group if g else 3 * per_group):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(words).replace("w1", "W1") if rng.random() < 0.3 else "  ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "percent", "block"), ((3, 85, 2_000_000), (5, 80, 300)))
def test_same_components_as_by_all_pairs(spark, make_docs, monkeypatch, words, percent, block):
    monkeypatch.setattr(near, "BLOCK", block)  # small ones: groups are dealt to many blocks
    texts = [*copies(), "", None, "one", "One", "two words", " \t", "three words here", "é é é", "É é é"]
    got = near.near_duplicates(spark, make_docs(texts), words=words, percent=percent).collect()
    assert sorted(map(tuple, got)) == expected(list(enumerate(texts)), words, percent)


def test_odd_rows(spark, odd_docs):
    got = sorted(map(tuple, near.near_duplicates(spark, odd_docs).collect()), key=str)
    assert len(got) == odd_docs.count()
    by_id = {r[0]: r for r in got}
    assert by_id[4][2:] == (3, False) and by_id[3][2:] == (3, True) and by_id[0] == (0, 0, 0, True)
    assert by_id[None] == (None, 1, None, True)
    assert near.near_duplicates(spark, odd_docs.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each_group(spark, make_docs):
    docs = make_docs(copies(seed=2, groups=3))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    kept = near.deduplicated(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, keep in expected(pairs, 5, 80) if keep]


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(4)
    rows = []
    for pair in range(60):
        one = rng.integers(0, 1 << 16, near.VALUES).astype("<u2")
        other = one.copy()
        other[rng.choice(near.VALUES, near.DISTANCE, replace=False)] += 1
        rows += [(pair, one.tobytes()), (pair, other.tobytes())]
    keyed = spark.createDataFrame(rows, "pair int, signature binary").select("pair", F.explode(F.array(*near._keys())).alias("key"))
    met = keyed.groupBy("pair", "key").count().where("count > 1").select("pair").distinct()
    assert met.count() == 60


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = closed([p for p in links if p[0] != p[1]], nodes)
    assert {r.node: r.component for r in graph.components(spark, frame).collect()} == want
    assert graph.components(spark, frame.limit(0)).count() == 0


def test_rows_that_share_an_id_but_not_a_text(spark, make_docs):
    """Each has the links of its own text, in the result and in what stays."""
    a, b = (" ".join(f"{letter}{i}" for i in range(60)) for letter in "ab")
    near_a, near_b = f"{a} more", f"{b} more"
    pairs = [(1, a), (1, b), (2, near_a), (3, near_b), (1, b), (4, "alone"), (None, a), (5, None), (5, "")]
    docs = make_docs([]).union(spark.createDataFrame([(i, t, "en", "x", 1, "k", 0) for i, t in pairs], make_docs([]).schema))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near.near_duplicates(spark, docs).collect())
    assert [(i, c, kept) for i, _, c, kept in got] == [
        (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (5, 5, True),
    ]
    stay = sorted((r.doc_id or 0, r.text or "") for r in near.deduplicated(spark, docs).collect())
    assert stay == sorted([(0, a), (1, a), (1, b), (1, b), (4, "alone"), (5, ""), (5, "")])


def test_one_text_of_an_id_goes_and_the_other_stays(spark, make_docs):
    a = " ".join(f"a{i}" for i in range(60))
    pairs = [(1, a), (7, f"{a} more"), (7, "something else, linked with nothing"), (8, "x y")]
    docs = make_docs([]).union(spark.createDataFrame([(i, t, "en", "x", 1, "k", 0) for i, t in pairs], make_docs([]).schema))
    stay = sorted((r.doc_id, r.text) for r in near.deduplicated(spark, docs).collect())
    assert stay == sorted([(1, a), (7, "something else, linked with nothing"), (8, "x y")])


def test_columns_that_are_named_like_the_operators_own(spark, make_docs):
    docs = make_docs(copies(seed=3, groups=2)).withColumnsRenamed({"node": "own_id", "key": "own_text", "lang": "_gone_id"})
    assert near.deduplicated(spark, docs).columns == docs.columns


def test_parts_of_a_large_group_that_only_meet_in_the_middle(spark, make_docs, monkeypatch):
    """A chain: neighbours are similar, and no representative is similar to most of them."""
    monkeypatch.setattr(near, "BLOCK", 500)
    monkeypatch.setattr(near, "REPRESENTATIVES", 2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 120, 3)] + [" ".join(words[150 + i : 240 + i]) for i in range(0, 40, 4)]
    got = near.near_duplicates(spark, make_docs(texts), words=3, percent=85).collect()
    assert sorted(map(tuple, got)) == expected(list(enumerate(texts)), 3, 85)


def test_one_cluster_with_a_third_of_all_rows(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4000)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(300):
        words = list(base) if i % 3 == 0 else [f"v{rng.randrange(10_000)}" for _ in range(60)]
        words[rng.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    got = near.near_duplicates(spark, make_docs(texts), words=3, percent=85).collect()
    assert sorted(map(tuple, got)) == expected(list(enumerate(texts)), 3, 85)
