"""Nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are normalised and rotated at random, so that a distance over the first dimensions is an unbiased estimate
of the whole one. Each vector belongs to the list of its nearest centroid. A query scans the lists of its nearest
centroids, block of columns by block of columns; after each block a hypothesis test compares the estimate with the
distance of the worst neighbour kept, and abandons candidates that are farther with near certainty. What is left is
scored by the cosine of the original vectors in double precision.

Rotation, centroids and the number of lists to scan are fitted on a bounded sample (`FIT` vectors): so many lists are
scanned that `COVERAGE` of the sample's true neighbours lie in them. Every vector is indexed. Equal vectors are indexed
once, with their smallest ids; no more of them can be among a query's nearest. Long lists and many queries for one list
are dealt to blocks, and each pair of blocks is a task.

A query that finds too few vectors there, because its neighbours lie in other lists, is compared with every vector, in
blocks too, and without any test.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import common

FIT, TRIED, COVERAGE = 20_000, 300, 0.98
MOST_LISTS, BLOCK_VECTORS, BLOCK_QUERIES = 500, 20_000, 4_000
#: Columns per block; how many standard errors an estimate must be off to keep a candidate that should go.
COLUMNS, ERRORS = 16, 2.1
#: Parts that a search over all vectors is dealt to at least, if there are as many lists.
PARTS = 16
FOUND = "query_id bigint, rank int, vec_id bigint, score double"


class Index:
    """What every task needs to place vectors and queries."""

    def __init__(self, sample: np.ndarray, total: int, neighbours: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n, self.dimension = sample.shape
        self.rotation, _ = np.linalg.qr(rng.standard_normal((self.dimension, self.dimension)))
        x = self.turned(sample)
        lists = int(np.clip(np.sqrt(total) / 2, 1, min(MOST_LISTS, max(1, n // 40))))
        self.centroids = _centroids(x, lists, rng)
        self.near = x[rng.choice(n, min(n, 4000), replace=False)]
        self.neighbours = neighbours
        self.probes = self._probes(x, rng)

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        return ((vectors / norm[:, None]) @ self.rotation).astype(np.float32)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T, axis=1)

    def _probes(self, x: np.ndarray, rng) -> int:
        tried = rng.choice(len(x), min(len(x), TRIED), replace=False)
        order = np.argsort(-(x[tried] @ self.centroids.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        near = x[tried] @ x.T
        near[np.arange(len(tried)), tried] = -2
        k = min(self.neighbours, len(x) - 1)
        if k < 1:
            return len(self.centroids)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        needed = np.take_along_axis(place, self.lists(x)[best], axis=1)
        return int(np.quantile(needed, COVERAGE, method="higher")) + 1

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Squared distances within which each query surely has enough neighbours, in whatever lists: the sample's."""
        k = self.neighbours + 1
        if len(self.near) <= k:
            return np.full(len(x), 4.1, dtype=np.float32)
        distance = 2 - 2 * (x @ self.near.T)
        return np.partition(distance, k, axis=1)[:, k] + 1e-4


def _centroids(x: np.ndarray, lists: int, rng, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centroids = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centroids)
    return centroids


def scan(query: np.ndarray, columns: list[np.ndarray], bound: float, most: int) -> np.ndarray:
    """Candidates that survive the tests. `columns` are the list's column blocks; `bound` a squared distance.

    After each chunk of candidates the bound falls to the squared distance of the `most`-th nearest so far.
    """
    n, dimension = len(columns[0]), len(query)
    survivors, distances = np.empty(0, np.int64), np.empty(0, np.float32)
    start, chunk = 0, 256
    while start < n:
        alive = np.arange(start, min(n, start + chunk))
        start, chunk = start + chunk, chunk * 2
        part, done = np.zeros(len(alive), dtype=np.float32), 0
        for block in columns:
            width = block.shape[1]
            away = block[alive] - query[done : done + width]
            part += np.einsum("ij,ij->i", away, away)
            done += width
            limit = bound * (done / dimension) * (1 + ERRORS / np.sqrt(done)) ** 2 if done < dimension else bound
            keep = part <= limit + 1e-5
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        survivors, distances = np.r_[survivors, alive], np.r_[distances, part]
        if len(distances) >= most:
            bound = min(bound, float(np.partition(distances, most - 1)[most - 1]))
    return survivors[distances <= bound + 1e-5]


def _valid(vector) -> np.ndarray | None:
    if vector is None:
        return None
    try:
        array = np.asarray(vector, dtype=np.float64)
    except (TypeError, ValueError):  # null components
        return None
    return array if len(array) and np.isfinite(array).all() and array.any() else None


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for vec_id, vector in zip(batch["vec_id"], batch["vector"], strict=True):
            array = _valid(vector)
            if array is not None:
                raw = (array + 0.0).tobytes()  # -0.0 is 0.0
                rows.append((vec_id, hashlib.blake2b(raw, digest_size=16).digest(), len(array), raw))
        yield pd.DataFrame(rows, columns=["vec_id", "key", "dimension", "raw"])


def _matrix(raw: pd.Series, dimension: int = -1) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dimension)


def _pieces(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows]


def nearest(
    spark: SparkSession, vectors: DataFrame, every: int = 50, neighbours: int = 5, id_column="vec_id",
    vector_column="embedding",
) -> DataFrame:
    """The nearest vectors by cosine of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Ties go to the smaller id; neighbours may be missed, as `COVERAGE` says, but others take their places. A query has
    fewer rows only if there are fewer candidates. Vectors are compared with those of their own length, which have an
    index of their own. Null, empty or zero vectors, those with null or non-finite components and rows with a null id
    take no part. Equal vectors under different ids are candidates each; a row repeated with its id is one candidate.
    An empty table gives no rows; other columns are not read.
    """
    common.ready_workers(spark)
    k = neighbours + 1  # a query is among its own nearest
    picked = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vector"))
    picked = picked.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    schema = "vec_id bigint, key binary, dimension int, raw binary"
    rows = common.staged(spark, picked.mapInPandas(_keyed, schema), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "key").distinct()
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))  # limited before the shuffle too
    smallest = rows.dropDuplicates(["vec_id", "key"]).withColumn("n", first).where(F.col("n") <= k)
    asked = queries.select("key").distinct().withColumn("asked", F.lit(True))
    different = smallest.groupBy("key").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("raw").alias("raw"),
        F.first("dimension").alias("dimension"),
    )
    different = common.staged(spark, different.join(asked, "key", "left"), "different")

    found = None
    lengths = [row["dimension"] for row in different.select("dimension").distinct().collect()]
    for dimension in sorted(lengths):
        part = _among(spark, different.where(F.col("dimension") == dimension), dimension, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], FOUND)
    by_score = [F.col("score").desc(), "vec_id"]
    pairs = queries.withColumnRenamed("vec_id", "query_id").join(found, "key").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= neighbours)


def _among(spark: SparkSession, different: DataFrame, dimension: int, k: int) -> DataFrame:
    """(key, vec_id, score): the best `k` of each vector asked for, among different vectors of one length."""
    total = different.count()
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = _matrix(different.where(share < min(1.0, FIT / total)).select("raw").toPandas()["raw"], dimension)
    if not len(sample):  # a few vectors, none of them picked
        sample = _matrix(different.orderBy("key").limit(FIT).select("raw").toPandas()["raw"], dimension)
    index = Index(sample, total, k)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            x = shared.value.turned(_matrix(batch["raw"]))
            yield batch.assign(list=shared.value.lists(x), turned=[row.tobytes() for row in x])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in _pieces(batches):
            x = known.turned(_matrix(batch["raw"]))
            near = x @ known.centroids.T
            p = known.probes
            lists = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < near.shape[1] else np.tile(np.arange(p), (len(x), 1))
            yield pd.DataFrame({
                "key": batch["key"], "raw": batch["raw"], "turned": [row.tobytes() for row in x],
                "bound": known.bounds(x).astype(np.float64), "lists": [row.tolist() for row in lists],
            })

    placed_schema = "key binary, ids array<bigint>, raw binary, turned binary, list int"
    placed = different.select("key", "ids", "raw").mapInPandas(place, placed_schema)
    placed = common.staged(spark, placed, "placed")
    probe_schema = "key binary, raw binary, turned binary, bound double, lists array<int>"
    probing = different.where("asked").select("key", "raw").mapInPandas(probe, probe_schema)
    probing = common.staged(spark, probing, "probing")

    def dealt(frame: DataFrame, grid: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(names[0])
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        return frame.join(F.broadcast(grid), "list").select(*frame.columns, block, each)  # at most MOST_LISTS rows

    def search(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"key": [], "ids": [], "score": []}
        if len(asking) and len(there):
            there = there.sort_values("key", ignore_index=True)
            x = np.frombuffer(b"".join(there["turned"]), np.float32).reshape(len(there), dimension)
            columns = [np.ascontiguousarray(x[:, a : a + COLUMNS]) for a in range(0, dimension, COLUMNS)]
            original = _matrix(there["raw"])
            norm = np.sqrt(np.einsum("ij,ij->i", original, original))
            least = np.array([ids[0] for ids in there["ids"]])
            for row in asking.itertuples(index=False):
                own = np.frombuffer(row.raw, np.float64)
                if np.isinf(row.bound):  # all are scored
                    score = original @ own / (norm * np.sqrt(own @ own))
                    last = max(0, len(score) - k)
                    found = np.flatnonzero(score >= np.partition(score, last)[last])
                    score = score[found]
                else:
                    found = scan(np.frombuffer(row.turned, np.float32), columns, row.bound, k)
                    score = original[found] @ own / (norm[found] * np.sqrt(own @ own))
                best = np.lexsort((least[found], -score))[:k]
                out["key"] += [row.key] * len(best)
                out["ids"] += [there["ids"][i].tolist() for i in found[best]]
                out["score"] += score[best].tolist()
        kinds = {"key": object, "ids": object, "score": np.float64}
        return pd.DataFrame({name: pd.Series(out[name], dtype=kind) for name, kind in kinds.items()})

    by_score = [F.col("score").desc(), "vec_id"]

    def searched(asking: DataFrame, there: DataFrame) -> DataFrame:
        """The best `k` of each key, over the lists it asks for."""
        sizes = there.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
        asks = asking.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("ask_blocks"))
        grid = sizes.join(asks, "list")  # a row per list
        left = dealt(asking, grid, "ask_blocks", "blocks", ("ask_block", "block"))
        right = dealt(there, grid, "blocks", "ask_blocks", ("block", "ask_block"))
        cell = ["list", "block", "ask_block"]
        best = left.groupBy(*cell).cogroup(right.groupBy(*cell))
        best = best.applyInPandas(search, "key binary, ids array<bigint>, score double")
        best = best.select("key", F.explode("ids").alias("vec_id"), "score")
        best = best.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*by_score)))
        return best.where(F.col("n") <= k).drop("n")

    found = common.staged(spark, searched(probing.withColumn("list", F.explode("lists")).drop("lists"), placed), "nearest")
    enough = min(k, placed.agg(F.sum(F.size("ids"))).first()[0])
    counted = found.groupBy("key").agg(F.count("*").alias("n"))
    short = probing.join(counted, "key", "left").where(F.coalesce("n", F.lit(0)) < enough).drop("n", "lists")
    short = common.staged(spark, short.withColumn("bound", F.lit(float("inf"))), "short")
    if not short.isEmpty():
        parts = min(PARTS, len(index.centroids))
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        whole = searched(everywhere, placed.withColumn("list", F.col("list") % parts))
        found = found.join(short.select("key"), "key", "left_anti").unionByName(whole)
        found = common.staged(spark, found, "whole")
    return found
