import random
import re
from collections import Counter

import numpy as np
import pytest

from roomledger.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, n int, term string, vector string"


def expected(rows, fewest, top=10):
    """From the whole matrix, in Python's integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower)))
        groups.setdefault(lang, set()).add(source)
        n.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= fewest]

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [
                (-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t)
                for t in kept if n[lang, s][t] and p[s][t] > q[t]
            ]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def documents(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé漢" for b in ["x", "Y", "zz", "ö"]] + ["Same", "it's", "under_score", "a1b"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), f"s{min(rng.randrange(12), rng.randrange(12))}"
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, None]), lang, rng.choice([source, source, source, None]), 1, "t", "v"))
    return rows + [(n, "", "fr", "a", 1, "t", "v"), (n + 1, "one two", "fr", "b", 1, "t", "v"), (n + 2, None, "it", "c", 1, "t", "v")]


def got(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    names = ("lang", "source", "part", "item", "value", "rank")
    return sorted(map(tuple, divergence.audit(spark, frame).select(*names).collect()))


@pytest.mark.parametrize("fewest", (10, 2))
def test_same_rows_as_from_the_whole_matrix(spark, monkeypatch, fewest):
    monkeypatch.setattr(divergence, "FEWEST", fewest)
    rows = documents(1)
    assert got(spark, rows) == expected(rows, fewest)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEWEST", 1)
    rows = documents(2, 20) + [(None, "a b " * 40_000, None, None, None, None, None)] * 2
    assert got(spark, rows) == expected(rows, 1)
    assert divergence.audit(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_one_source_with_a_third_of_all_rows(spark):
    rows = [(i, f"a b{i % 7} c d{i % 5}", "en", "hot" if i % 3 == 0 else f"s{i % 10}", 1, "t", "v") for i in range(600)]
    assert got(spark, rows) == expected(rows, 10)


def test_runs_give_the_dense_sum():
    rng = np.random.default_rng(3)
    for length in (1, 2, 17, 200):
        dense = rng.integers(0, 3, (2, length)) * rng.integers(0, 2, (2, length)).cumsum(axis=1).clip(0, 2)
        runs = []
        for column in dense:
            places = np.flatnonzero(column)
            starts, counts = divergence.encoded(places, column[places], length)
            assert (np.repeat(counts, np.diff(np.r_[starts, length])) == column).all() and (np.diff(counts) != 0).all()
            runs.append((starts, divergence.shares(counts, int(column.sum()), length)))
        p, q = (divergence.shares(c, int(c.sum()), length) for c in dense)
        assert divergence.divergence(*runs, length) == sum((a - b) ** 2 // (a + b) for a, b in zip(p.tolist(), q.tolist(), strict=True))


def test_shares_of_large_counts_are_exact():
    counts, whole = np.array([0, 5, 10**13]), 10**13 + 5
    assert divergence.shares(counts, whole, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (whole + 6) for c in counts]
