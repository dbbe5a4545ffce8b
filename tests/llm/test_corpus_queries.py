from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tokenizers

import __spark_entry__
import corpus_pipeline
from roomledger.llm import common, queries
from tests.conftest import comparable
from tests.llm.test_near import expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns, rows = [d[0] for d in result.description], result.fetchall()
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    assert comparable(frame.columns, frame.collect()) == comparable(columns, rows)


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in names if name.startswith("op")}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


def test_pipeline(spark):
    """Every stage against what it must do to the rows that the stage before kept."""
    docs = common.table(spark, SF, "documents")
    columns, after = docs.columns, {}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(spark, stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name == "toxicity":
            found = queries.QUERIES["op2_string_kernel"](spark, SF)
            assert set(after) == {r.doc_id for r in found.collect() if not r.predicted}
        elif name == "exact_dedup":
            assert set(after) == set({r.text: i for i, r in sorted(before.items())}.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in expected([(i, r.text) for i, r in before.items()], 5, 80) if kept}
        elif name == "secret_scan":
            assert set(after) == set(before)
            changed = [i for i in after if after[i].text != before[i].text]
            assert changed and all("[secret]" in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)
        if name != "secret_scan":
            assert all(after[i] == before[i] for i in after)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: 1 + len(library.encode(r.text or "", add_special_tokens=False).ids) for i, r in after.items()}
    totals = dict.fromkeys(sizes, 0)
    for r in pieces:
        totals[r.doc_id] += r.length
    assert totals == sizes
    assert Path(SF).exists()


def test_earlier_stages_are_removed(spark, monkeypatch):
    """Only the last staged documents are left: neither earlier ones nor what stages wrote on their way."""

    def stage(spark, docs, sf_dir):
        return common.staged(spark, docs.where("doc_id % 7 <> 0"), "inner")

    left = Path(common.shared_dir(spark)) / "roomledger-llm"
    left.mkdir(exist_ok=True)
    before = {p.name for p in left.iterdir()}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage), ("last", stage)])
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == common.table(spark, SF, "documents").where("doc_id % 7 <> 0").count()
    assert sorted(p.name.split("-")[0] for p in left.iterdir() if p.name not in before) == ["inner", "three"]
