import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomledger.llm import langid

SF = Path("/root/testdata/sf0.01")
EN = "the thing and the other thing with that which these those this would have been where there".split()
DE = "der die das und nicht schon auch über zwischen während gewesen möchte straße können".split()
RU = "это что когда никогда потому где очень хорошо человек время".split()


def model():
    return langid.Model({"en": dict.fromkeys(EN, 50), "de": dict.fromkeys(DE, 50), "ru": dict.fromkeys(RU, 50)})


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    for lengths in ([1, 5, 3], [6, 6, 2, 1]):
        rows = [rng.normal(0, 3, (n, 3)) for n in lengths]
        for scores, path in zip(rows, langid.viterbi(rows, 2.0), strict=True):
            def value(p, scores=scores):
                return sum(scores[t, x] for t, x in enumerate(p)) - 2 * sum(a != b for a, b in itertools.pairwise(p))
            best = max(value(p) for p in itertools.product(range(3), repeat=len(scores)))
            assert value(path) == pytest.approx(best)


def test_spans_of_mixed_text():
    known = model()
    text = " ".join(EN) + ". " + " ".join(DE) + " 12 " + " ".join(RU)
    row = langid._labelled(known, [text], True)[0]
    assert [x for _, _, x in row[3]] == ["en", "de", "ru"]
    assert [text[a:].split()[0] for a, _, _ in row[3]] == ["the", "der", "это"]
    assert row[3][0][0] == 0 and row[3][-1][1] == len(text)


def test_scripts_narrow_the_candidates():
    known = model()
    known.learn({"xyzzy", "жук"})
    scores = known.scores[known.known["жук"]]
    assert scores[known.languages.index("ru")] > langid.FLOOR and scores[known.languages.index("en")] == langid.NEVER
    assert known.scores[known.known["xyzzy"]][known.languages.index("ru")] == langid.NEVER


def test_odd_rows(spark, odd_docs):
    got = {r.doc_id: r for r in langid.labelled(spark, odd_docs, with_spans=True).collect()}
    assert len(got) == 10
    for i in (0, 1, 2, 7):
        assert (got[i].lang_pred, got[i].score, got[i].n_spans) == ("und", 0.0, 0)
    assert got[3].lang_pred == "en" and got[3].score == 1.0
    assert langid.labelled(spark, odd_docs.limit(0)).count() == 0
    blank = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.labelled(spark, blank).collect()} == {"und"}


def test_words_late_in_long_texts_are_learnt(spark):
    header = "licence " * 1500
    rows = [(i, header + " ".join(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(40)]
    known = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for language, words in (("en", EN), ("de", DE)):
        assert langid._labelled(known, [" ".join(words)], False)[0][:2] == (language, 1.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.labelled(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
