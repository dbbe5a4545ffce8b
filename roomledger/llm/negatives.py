"""Hard negatives by a secondary sort.

Scores of (anchor, row) pairs get the key (anchor, descending score, kind, id), of which the anchor decides the
partition and all of it the order. An iterator then sees an anchor's pairs from the highest score down: the first
positives open a window each, and a negative is emitted to every window that is open for it. It holds the
windows of one anchor, never its pairs.

Scores are computed in blocks: rows are dealt to blocks by a hash of their id, and meet each block of anchors in one
task. What leaves such a task is bounded for each anchor: its best positives there, and, once the best of all
blocks are known, its best negatives for each of their windows. No pair that is in the result can be lost by that, as
it is among the best of its own block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import common

#: Rows and anchors of a block, about; scores computed at once.
ROWS, ANCHORS, AT_ONCE = 50_000, 20_000, 4_000_000
POSITIVES, NEGATIVES = 5, 10
#: The window of negatives, in hundredths of the positive's score.
LOW, HIGH = 30, 90
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
PAIR = "anchor_id bigint, score bigint, negative boolean, row_id bigint"
_PAIR = pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("negative", pa.bool_()), ("row_id", pa.int64())])
_EXACT = 1 << 53


def usable(vectors: DataFrame, id_column="vec_id", vector_column="embedding", label_column="label") -> DataFrame:
    """(id, label, v): rows that take part, labels corrected where the id is divisible by 7, components as integers."""
    key, label = F.col(id_column).cast("bigint"), F.col(label_column).cast("bigint")
    x = F.col(vector_column).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    picked = vectors.where(key.isNotNull() & label.isNotNull() & x.isNotNull() & sound)
    corrected = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    whole = F.transform(x, lambda c: F.floor(c * 256.0).cast("bigint"))
    return picked.select(key.alias("id"), corrected.alias("label"), whole.alias("v"))


class _Block:
    """Rows in ascending order of ids, one of each id, for vectors of each length."""

    def __init__(self, table: pa.Table):
        lists = pa.concat_arrays(table.column("v").chunks)
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        chosen: dict[int, tuple[int, int]] = {}
        for i, (key, label) in enumerate(zip(*(table.column(c).to_pylist() for c in ("id", "label")), strict=True)):
            if key in chosen:  # of rows with one id the least by label and components
                other, at_other = chosen[key]
                if (other, flat[at[at_other] : at[at_other + 1]].tolist()) <= (label, flat[at[i] : at[i + 1]].tolist()):
                    continue
            chosen[key] = label, i
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for key, (label, i) in sorted(chosen.items()):
            by_length.setdefault(int(at[i + 1] - at[i]), []).append((key, label, i))
        self.parts = {}
        for length, rows in by_length.items():
            key, label, i = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
            matrix = flat[(at[i][:, None] + np.arange(length)).ravel()].reshape(len(i), length)
            self.parts[length] = key, label, matrix


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    top = lambda m: max((abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))))
    bound = top(anchors) * top(rows) * max(1, anchors.shape[1])
    if bound < _EXACT:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return anchors @ rows.T
    return np.array(anchors.astype(object) @ rows.T.astype(object)).astype(np.int64)  # loud over 64 bits


def best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by smaller id; `ids` are in ascending order."""
    places = np.arange(len(score))
    if len(score) > n:
        places = np.flatnonzero(score >= np.partition(score, -n)[-n])
    return places[np.argsort(-score[places], kind="stable")][:n]


def _scored(rows: pa.Table, anchors: pa.Table, choose) -> pa.Table:
    """What `choose` takes of each anchor's scores with the rows of a block."""
    if not rows.num_rows or not anchors.num_rows:
        return _PAIR.empty_table()
    left, right = _Block(anchors), _Block(rows)
    out = []
    for length, (anchor_ids, anchor_labels, anchor_matrix) in left.parts.items():
        if length not in right.parts:
            continue
        ids, labels, matrix = right.parts[length]
        step = max(1, AT_ONCE // len(ids))
        for a in range(0, len(anchor_ids), step):
            part = scores(anchor_matrix[a : a + step], matrix)
            for anchor, label, score in zip(anchor_ids[a : a + step].tolist(), anchor_labels[a : a + step], part, strict=True):
                same = labels == label
                for negative, places in choose(anchor, score, ids, same):
                    n = len(places)
                    out.append((np.full(n, anchor), score[places], np.full(n, negative), ids[places]))
    if not out:
        return _PAIR.empty_table()
    columns = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PAIR, strict=True)], schema=_PAIR)


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    def choose(anchor, score, ids, same):
        places = np.flatnonzero(same & (ids != anchor))
        yield False, places[best(score[places], ids[places], POSITIVES)]

    return _scored(rows, anchors, choose)


def window(score: int) -> tuple[int, int]:
    """The least and the most that a negative of this positive may score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    opened = dict(zip(anchors.column("id").to_pylist(), anchors.column("positive_scores").to_pylist(), strict=True))

    def choose(anchor, score, ids, same):
        other = np.flatnonzero(~same)
        theirs, found = score[other], []
        for positive in set(opened[anchor] or []):
            low, high = window(positive)
            inside = other[(theirs >= low) & (theirs <= high)]
            found.append(inside[best(score[inside], ids[inside], NEGATIVES)])
        if found:
            yield True, np.unique(np.concatenate(found))

    return _scored(rows, anchors, choose)


def mined(pairs: Iterator[tuple[tuple, None]]) -> Iterator[tuple]:
    """Rows of the result from pairs in the order of their keys (anchor, -score, is a negative, id).

    At one score positives come before negatives, so a window is open when its first negative comes.
    """
    anchor, opened, n_positives = None, [], 0
    for (here, score, negative, row_id), _ in pairs:
        score = -score
        if here != anchor:
            anchor, opened, n_positives = here, [], 0
        if not negative:
            n_positives += 1
            low, high = window(score)
            if n_positives <= POSITIVES and low <= high:
                opened.append([row_id, score, low, high, 0])
            continue
        for positive in opened:
            positive_id, positive_score, low, high, n = positive
            if low <= score <= high and n < NEGATIVES:
                positive[4] = n + 1
                yield anchor, positive_id, n + 1, row_id, positive_score, score


def _dealt(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with the blocks (i, j) in which they meet: each row in its i, each anchor in its j."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = rows.select("*", own(n_rows).alias("i"), every(n_anchors).alias("j"))
    return rows, anchors.select("*", every(n_rows).alias("i"), own(n_anchors).alias("j"))


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, every: int = 100, id_column="vec_id", vector_column="embedding",
    label_column="label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors with id % every = 0.

    Scores are inner products of components times 256, rounded down. An anchor's positives are its POSITIVES best
    other rows of its label, a positive's negatives the NEGATIVES best rows of other labels that score LOW to HIGH
    hundredths of it; ties go to the smaller id. A positive below zero has no such rows, and pairs without any are left
    out. Rows with a null id, label or vector, or a null or non-finite component, take no part; only vectors of one
    length are compared. Of rows that repeat an id, the least by label and components counts. Scores over 64 bits
    raise an error. An empty table gives no rows; other columns are not read.
    """
    common.ready_workers(spark)
    rows = common.staged(spark, usable(vectors, id_column, vector_column, label_column), "vectors")
    anchors = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("least"))
    anchors = common.staged(spark, anchors.select("id", "least.label", "least.v"), "anchors")
    n_rows = max(-(-rows.count() // ROWS), spark.sparkContext.defaultParallelism)
    n_anchors = max(1, -(-anchors.count() // ANCHORS))

    def met(anchors: DataFrame, choose) -> DataFrame:
        left, right = _dealt(rows, n_rows, anchors, n_anchors)
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(choose, PAIR)

    first = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "row_id")
    positives = met(anchors, _positives).withColumn("place", F.row_number().over(first))
    positives = common.staged(spark, positives.where(F.col("place") <= POSITIVES).drop("place"), "positives")
    scored = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("score").alias("positive_scores"))
    negatives = met(anchors.join(scored, "id"), _negatives)
    pairs = common.staged(spark, positives.unionByName(negatives), "pairs")

    keyed = pairs.rdd.map(lambda p: ((p.anchor_id, -p.score, p.negative, p.row_id), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: hash((key[0], 0)))
    return spark.createDataFrame(ordered.mapPartitions(mined), MINED, verifySchema=False)
