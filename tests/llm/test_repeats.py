import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from roomledger.llm import repeats


def expected(pairs, words):
    """By all windows of all rows."""
    spoken = [(i, (text or "").encode().split()) for i, text in pairs]
    times = Counter(tuple(w[a : a + words]) for _, w in spoken for a in range(len(w) - words + 1))
    out = []
    for i, w in spoken:
        gone = set()
        for a in range(len(w) - words + 1):
            if times[tuple(w[a : a + words])] > 1:
                gone.update(range(a, a + words))
        left = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return Counter(out)


def found(spark, docs, words):
    return Counter(map(tuple, repeats.without_repeats(spark, docs, words=words).collect()))


def passages(seed, n=60, words=12):
    """Texts with passages in common, some just too short, at their ends, overlapping, or of few words."""
    rng = random.Random(seed)
    shared = [[f"p{rng.randrange(50)}" for _ in range(rng.randint(words - 1, 5 * words))] for _ in range(6)]
    shared += [["ab", "cd"] * words, ["la"] * (2 * words)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 2 * words))]
            passage = rng.choice(shared)
            a = rng.randrange(len(passage))
            parts += passage[a:] if rng.random() < 0.5 else passage
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    return texts + [texts[3], "  " + texts[4] + "\t"]


@pytest.mark.parametrize("largest", (1000, 3))  # 3: most anchors take the way of the frequent ones
def test_same_words_as_by_all_windows(spark, make_docs, monkeypatch, largest):
    monkeypatch.setattr(repeats, "LARGEST", largest)
    texts = passages(1)
    got = found(spark, make_docs(texts), 12)
    assert got == expected(list(enumerate(texts)), 12)
    assert any(row[2] for row in got) and any(0 < row[2] < row[1] for row in got)


def test_one_passage_in_a_third_of_all_texts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "LARGEST", 50)
    rng = random.Random(5)
    line = " ".join(f"l{i}" for i in range(50))
    texts = [f"a{i} {rng.random()} {line if i % 3 == 0 else i} {rng.random()} z{i}" for i in range(600)]
    got = found(spark, make_docs(texts), 35)
    assert got == expected(list(enumerate(texts)), 35)
    assert Counter(row[2] for row in got.elements()) == {50: 200, 0: 400}


def test_odd_rows(spark, odd_docs):
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(spark, odd_docs, 3) == expected(pairs, 3)
    assert found(spark, odd_docs, 35) == expected(pairs, 35)
    assert repeats.without_repeats(spark, odd_docs.limit(0)).count() == 0


def test_suffix_tree_is_sorted_with_the_lengths_in_common():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 40, 12)
        symbols = rng.integers(0, 3, sizes.sum())
        ends = np.repeat(np.cumsum(sizes), sizes)
        starts = np.flatnonzero(rng.random(len(symbols)) < 0.7)
        order, shared = repeats.suffix_tree(symbols, ends, starts)
        suffixes = [tuple(symbols[i : ends[i]]) for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == starts.tolist()
        for n, (a, b) in enumerate(zip(suffixes, suffixes[1:], strict=False), 1):
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[n] == same


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    for words in (1, 2, 5, 35):
        one = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        other = np.concatenate([rng.integers(0, 1 << 63, 77).astype(np.uint64), one[40:160]])
        given = [one, np.empty(0, np.uint64), other[:34], other, one[:1]]
        lengths = np.array(list(map(len, given)))
        text, first, n, anchor = repeats.anchors(np.concatenate(given), lengths, words)
        anchor_of = {}
        for t, a, k, x in zip(text, first, n, anchor, strict=True):
            anchor_of.update({(t, i): x for i in range(a, a + k)})
        assert sorted(anchor_of) == [(t, i) for t, size in enumerate(lengths) for i in range(size - words + 1)]
        for i in range(120 - words + 1):
            assert anchor_of[0, 40 + i] == anchor_of[3, 77 + i]


def test_groups_are_cut_between_anchors():
    import pyarrow as pa

    rows = []
    for anchor in range(400):
        segment = " ".join(f"s{anchor}_{i}" for i in range(40)).encode()
        for copy in range(2 if anchor % 2 else 1):
            rows.append((anchor, bytes([copy]) + anchor.to_bytes(2, "big"), 7, 6, segment))
    frames = [repeats._batch(rows[a : a + 60], repeats._SEGMENTS) for a in range(0, len(rows), 60)]
    for size in (1, 5_000, 1 << 30):
        before, repeats.GROUP_BYTES = repeats.GROUP_BYTES, size
        try:
            out = pa.Table.from_batches(list(repeats._trees(35)(iter(frames)))).to_pylist()
        finally:
            repeats.GROUP_BYTES = before
        want = sorted(r[1] for r in rows if r[0] % 2)
        assert sorted(r["key"] for r in out) == want and {(r["first"], r["end"]) for r in out} == {(7, 47)}
