import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomledger.llm import toxicity

SF = Path("/root/testdata/sf0.01")


def brute(word):
    out = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if max(j - i, k - j) <= toxicity.GAP and word[i].isalnum() and word[j].isalnum() and word[k].isalnum():
            key = word[i] + word[j] + word[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    return out


def test_kernel_is_that_of_the_definition():
    words = ["idiot", "i.d.i.o.t", "idiiot", "thing", "ab", "été", "aaaa", "worthless"]
    got = toxicity.Landmarks(words[:4]).kernel(words)
    for a, one in enumerate(words):
        for b, other in enumerate(words[:4]):
            x, y = brute(one), brute(other)
            dot = sum(v * y.get(k, 0) for k, v in x.items())
            norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert got[a, b] == pytest.approx(np.exp(toxicity.SHARP * ((dot / norm if norm else 0) - 1)), rel=1e-4)


def test_kernel_multiplies_only_codes_that_landmarks_hold():
    """The work of a unit grows with the landmarks that share its codes, not with all landmarks."""
    apart = toxicity.Landmarks([chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) + chr(0x4E02 + 3 * i) for i in range(500)])
    assert apart.n.max() == 1 and len(apart.weights) == 500
    got = apart.kernel([*apart.words[:3], "none"])
    assert np.allclose(got[:3, :3][~np.eye(3, dtype=bool)], np.exp(-toxicity.SHARP)) and np.allclose(got.diagonal()[:3], 1)
    wide = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 3000))
    assert [len(x) for x in toxicity.subsequences([wide, "abca"])][0] == sum(
        max(0, 3000 - a - b) for a in range(1, toxicity.GAP + 1) for b in range(1, toxicity.GAP + 1)
    ) + len(brute("abca"))


def test_sparse_sums_round_as_dense_ones(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé1.-OP"), rng.integers(1, 48))) for _ in range(400)]
    landmarks = toxicity.Landmarks([w for w in words if len(w) > 8][:60])
    got = landmarks.kernel(words)
    monkeypatch.setattr(toxicity, "LONG", 0)
    assert np.array_equal(got, landmarks.kernel(words))


def test_codes_are_found_alike_by_table_and_by_bisection(monkeypatch):
    words = ["idiot", "i.d.i.o.t", "été", "日本語日本", "ab", "---", "x9x9x", "", "Größe"]
    landmarks = toxicity.Landmarks([w for w in words if w != "x9x9x"])
    got = landmarks.kernel(words)
    monkeypatch.setattr(toxicity, "TABLE", 0)
    assert np.array_equal(got, landmarks.kernel(words))
    assert landmarks.kernel(["", "--"]).max() == pytest.approx(np.exp(-toxicity.SHARP))


def trained(seed=0):
    rng = np.random.default_rng(seed)
    parts = ["the", "and", "ing", "tion", "er", "on", "st", "ly", "ou", "re", "ble", "ent"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.integers(8, 60))]
        if i % 4 == 0:
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(len(words))] = str(rng.choice(["idiot", "moron", "worthless", "pathetic"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return toxicity.train(texts, labels)


def score(machine, text):
    return machine.score(machine.features(machine.units([text])[0]))


def test_gapped_and_inserted_insults_are_found():
    machine = trained()
    assert score(machine, "the thing and the stentone re") < 0.3
    for insult in ("idiot", "i.d.i.o.t", "i d i o t", "i-d-i-o-t", "p_a_t_h_e_t_i_c", "wor.thless", "(MORON)", "m*o*r*o*n",
                   "idi ot", "pathe tic", "i  d  i  o  t"):
        assert score(machine, f"the thing and {insult} the stentone re {insult}") > 0.5, insult
    assert 0 <= score(machine, "") < 0.5


def test_a_pair_of_fragments_is_judged_once():
    """The work on neighbouring fragments grows with the different pairs, not with all places where they stand."""
    machine, asked = trained(), []

    class Marks(set):
        def __contains__(self, part):
            asked.append(part)
            return super().__contains__(part)

    machine.marks = Marks(machine.marks)
    once = machine.features(machine.units(["the idi ot and idi ot"])[0])
    n = len(asked)
    assert n and once[5] > 0
    again = [machine.features(found) for found in machine.units(["the idi ot and idi ot"] * 50)]
    assert len(asked) == n and all(np.array_equal(f, once) for f in again)


def test_scores_do_not_depend_on_what_is_kept(monkeypatch):
    texts = ["the idi ot and", "", "the thing MORON moron", "i d i o t", "pathe tic idi ot", "ing " + "x" * 200] * 3
    machine = trained()
    want = [machine.features(found) for found in machine.units(texts)]
    monkeypatch.setattr(toxicity, "KEPT", 2)
    got = [machine.features(machine.units([text])[0]) for text in texts]
    assert np.allclose(got, want, atol=1e-5) and len(machine.units([])) == 0


def test_insults_late_in_long_texts_are_learnt(spark):
    rng = np.random.default_rng(5)
    parts = ["the", "and", "ing", "tion", "er", "on", "st", "ly", "ou", "re", "ble", "ent"]
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(120):
        text = ". ".join(" ".join(rng.choice(words, 12)) for _ in range(350))
        assert len(text) > 20_000
        rows.append((i, text + (f". {words[0]} idiot {words[1]}" if i % 3 == 0 else "") + "."))
        labels.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.fit(docs, labels)
    assert machine is not None
    assert machine.margins(["idiot"])["idiot"] > 0
    assert score(machine, rows[0][1]) > 0.5 > score(machine, rows[1][1])


def test_odd_rows_without_and_with_labels(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.scored(spark, odd_docs, labels)
    assert [(r.score, r.predicted) for r in got.collect()] == [(0.0, 0)] * odd_docs.count()
    labels = spark.createDataFrame([(i, None, 1 if i == 3 else 0) for i in range(9)] + [(None, 1, 1), (5, 1, None)], labels.schema)
    rows = toxicity.scored(spark, odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(spark, odd_docs.limit(0), labels).count() == 0
    assert toxicity.kept(spark, odd_docs, labels).columns == odd_docs.columns


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.scored(spark, docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    right = found.select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.93
