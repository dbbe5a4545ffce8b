"""Corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

All stages but the last return rows of `documents`, with its columns. Clean documents pass every one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roomledger.llm import common, dedup, near, packing, secrets, toxicity

END_ID = 2


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; learns from the labels of a share of `docs`.

    Every row is judged by its own text, whatever its id. Null and empty texts stay.
    """
    return toxicity.kept(spark, docs, common.table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays, and one of the rows that repeat it.

    Null and empty texts are equal. A null id is smaller than any other. Other texts under the same id are judged on
    their own.
    """
    return dedup.deduplicated(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by runs of five words in common at a similarity of 0.8, the smallest id stays.

    Texts without words, and rows with a null id, are connected with nothing and stay.
    """
    return near.deduplicated(spark, docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, and `n_chars` follows; every document stays, null and empty texts as they are."""
    return secrets.redacted(spark, docs, length_column="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with the sequence and offset of each; a null or empty text is one token."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: Learned models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has staged is removed when its own rows are written, and these when the
    next stage's are: earlier texts hold secrets that are masked later. An empty table goes through all stages."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, name)
        with common.cleared(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
