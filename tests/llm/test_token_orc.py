import zlib
from array import array

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from roomledger.llm import common, token_orc

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_hold_all_ids_in_order(spark, odd_docs):
    out = common.scratch(spark, "orc-test")
    token_orc.write(spark, odd_docs, PATH, out, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_orc.index(spark, out).collect())
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = []
    for r in odd_docs.collect():
        rows.append((-1 if r.doc_id is None else r.doc_id, array("I", library.encode(r.text or "", add_special_tokens=False).ids + [2]).tobytes()))
    start, want = 0, []
    for doc_id, ids in sorted(rows):
        want.append((start, None if doc_id < 0 else doc_id, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want


def test_empty_table(spark, make_docs):
    out = common.scratch(spark, "orc-test")
    token_orc.write(spark, make_docs([]), PATH, out, 2)
    assert token_orc.index(spark, out).count() == 0


def test_a_filter_on_ids_reaches_the_metadata(spark, make_docs):
    out = common.scratch(spark, "orc-test")
    token_orc.write(spark, make_docs([f"text {i}" for i in range(5000)]).repartition(4), PATH, out, 2)
    one = token_orc.read(spark, out).where("doc_id = 4711")
    assert "EqualTo(doc_id,4711)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1
    files = token_orc.read(spark, out).groupBy("file").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    spans = sorted((r.a, r.b) for r in files.collect())
    assert all(b < a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
