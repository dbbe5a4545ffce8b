import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from roomledger.llm import common, dedup


def expected(pairs):
    groups = {}
    for doc_id, text in pairs:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in pairs:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc_id, keep, len(ids), doc_id == keep, sha))
    return Counter(out)


def found(frame):
    return Counter(map(tuple, frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_odd_rows(spark, odd_docs):
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(dedup.duplicates(spark, odd_docs)) == expected(pairs)


def test_empty_table(spark, make_docs):
    assert dedup.duplicates(spark, make_docs([])).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, make_docs):
    rng = random.Random(3)
    pairs = list(enumerate(rng.choices(["aa", "bb", "cc", "dd", "e", ""], k=80)))
    weak = lambda text: F.substring(dedup.sha256(text), 1, 0)  # noqa: E731  the same for all texts
    frame = dedup.duplicates(spark, make_docs([t for _, t in pairs]), digest=weak)
    assert found(frame) == expected(pairs)


def test_state_goes_on_over_batches_and_never_expires(spark):
    arrivals, state = common.scratch(spark, "arrivals"), common.scratch(spark, "state")
    for start in (0, 5, 10):
        batch = [(bytes([i % 3]), 1, start + i, "f") for i in range(5)]
        spark.createDataFrame(batch, dedup.DIGESTS).coalesce(1).write.mode("append").parquet(arrivals)
        dedup.fed(spark, arrivals, state, batch_bytes=1)
    kept = {r.digest[0]: (r.keep_id, r.n) for r in dedup.retained(spark, state).collect()}
    assert kept == {0: (13, 6), 1: (14, 6), 2: (12, 3)}


def test_deduplicated_keeps_rows_and_columns(spark, odd_docs):
    kept = dedup.deduplicated(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd_docs.collect()})


def test_rows_that_share_an_id_but_not_a_text(spark, make_docs):
    pairs = [(7, "alpha"), (7, "beta"), (9, "beta"), (9, "beta"), (7, "beta"), (None, "beta"), (None, "gamma"), (None, "gamma")]
    odd = spark.createDataFrame([(i, t, "en", "x", 1, "k", 0) for i, t in pairs], make_docs([]).schema)
    stay = sorted((r.doc_id or 0, r.text) for r in dedup.deduplicated(spark, odd).collect())
    assert stay == [(0, "gamma"), (7, "alpha"), (9, "beta")]


def test_columns_that_are_named_like_the_operators_own(spark, odd_docs):
    named = odd_docs.withColumnsRenamed({"node": "own_id", "key": "own_digest_", "lang": "_kept_id", "n": "stays"})
    kept = dedup.deduplicated(spark, named)
    assert kept.columns == named.columns and kept.count() == dedup.deduplicated(spark, odd_docs).count()


def test_one_text_in_a_third_of_all_rows(spark, make_docs):
    texts = ["again and again" if i % 3 == 0 else f"text {i // 2}" for i in range(900)]
    docs = make_docs(texts).repartition(7)
    assert found(dedup.duplicates(spark, docs)) == expected(list(enumerate(texts)))
    assert sorted(r.doc_id for r in dedup.deduplicated(spark, docs).collect()) == sorted({t: i for i, t in enumerate(texts)}.values())
