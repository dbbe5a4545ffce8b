"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component): every node with a link, and the smallest node it is connected with.

    `links` has the bigint columns a and b. Alternates two star steps: each node links its larger neighbours, then its
    smaller ones and itself, to the smallest of its neighbourhood. Every step is a grouped minimum and a join, so
    a node with very many links is reduced before the shuffle. Tables in the shared folder cut the lineage. It
    ends when a round changes no link, after a number of rounds that grows with the logarithm of the nodes.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    links = links.where(F.col("a") != F.col("b")).select(most.alias("a"), least.alias("b")).distinct()
    links = common.staged(spark, links, "links")
    before = None
    while (now := _print(links)) != before:
        before = now
        links = common.staged(spark, _small_star(_large_star(links)), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _print(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where(F.col("b") > F.col("a")).join(least, "a")
    smaller = least.where(F.col("m") < F.col("a"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).union(smaller.select("a", F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.where(F.col("b") < F.col("a")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
