"""Documents packed into sequences of a fixed number of tokens: best-two-fit.

A bin is filled greedily with the longest pieces that fit. Then its smallest piece is replaced by two unpacked
ones, if some two fit the gap it leaves more tightly, until nothing improves.

Only lengths matter to this, so the plan is made on the counts per length, at most `size` numbers however
large the corpus is: a bin's pattern is used as often as the counts allow. Which piece takes which place follows
from its rank among the pieces of its length. Ranks come from counts per input task, so no length, however
common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import common, tokens

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
_RANK_BITS = 52


def best_two_fit(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), for counts[n] pieces of length n, 1 <= n <= size."""
    left = np.asarray(counts, dtype=np.int64).copy()
    if left[0] or len(left) != size + 1:
        raise ValueError("counts are given for the lengths 0 to size, and no piece is empty")
    plan = []
    while left.any():
        free = left.copy()
        gap, filled = size, []
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = int(min(free[length], gap // length))
            filled += [length] * n
            free[length] -= n
            gap -= n * length
        while gap:
            least = filled[-1]
            pair = _tightest_pair(free, least, gap + least)
            if pair is None:
                break
            filled[-1:] = pair
            free[least] += 1
            free[pair[0]] -= 1
            free[pair[1]] -= 1
            filled.sort(reverse=True)
            gap = size - sum(filled)
        times = min(int(left[length]) // n for length, n in Counter(filled).items())
        for length, n in Counter(filled).items():
            left[length] -= n * times
        plan.append((filled, times))
    return plan


def _tightest_pair(free: np.ndarray, above: int, most: int) -> list[int] | None:
    """Two free lengths with the largest sum over `above` and of at most `most`."""
    present = np.flatnonzero(free[: most + 1])
    if not len(present):
        return None
    below = np.zeros(most + 1, dtype=np.int64)  # the largest present length up to each
    below[present] = present
    below = np.maximum.accumulate(below)
    first = present[present < most]
    second = below[np.minimum(most - first, first)]
    alone = (second == first) & (free[first] < 2)
    second = np.where(alone, below[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= above:
        return None
    i = int(total.argmax())
    return [int(first[i]), int(second[i])]


def places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: the first sequence, pieces per sequence, and the first offset."""
    rows, used, base = [], Counter(), 0
    for filled, times in plan:
        offset = 0
        for length, n in sorted(Counter(filled).items(), reverse=True):
            rows.append((length << _RANK_BITS | used[length], used[length], base, n, offset))
            used[length] += n * times
            offset += n * length
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "sequence", "times", "offset"), table.T, strict=True))


def _cut(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        part, seen = TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            at = iter(ids)
            for run_of in tokens.slices(batch.column(1)):
                for got in encoder.encode(run_of):
                    doc_id, got = next(at), got + end
                    n = len(got) // 4
                    first = n if n <= size else n % size or size
                    cuts = [0, *range(first, n + 1, size)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(got[4 * a : 4 * b]), part, seen[b - a]))
                        seen[b - a] += 1
            yield _batch(rows, _PIECES)

    return run


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _assign(at: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            i = np.searchsorted(at["key"], length << _RANK_BITS | rank, side="right") - 1
            nth = rank - at["rank"][i]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [
                pa.array(at["sequence"][i] + nth // at["times"][i]),
                pa.array(at["offset"][i] + nth % at["times"][i] * length),
            ]
            names = [field.split()[0] for field in PACKED.split(", ")]
            yield pa.record_batch(columns, names=names)

    return run


def pack(
    spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, id_column="doc_id",
    text_column="text",
) -> DataFrame:
    """One row per piece: where its tokens are in the document, and its sequence and offset there.

    `path` is a byte-level tokenizer file. Every document ends with `end_id`, so null and empty texts are pieces of
    one token. Documents over `size` tokens are cut into pieces of `size`, of which the first may be shorter.
    Equal documents and repeated ids are packed each on their own; a null id stays null. An empty table gives no
    rows. Other columns are not read.
    """
    common.ready_workers(spark)
    common.small_batches(spark)
    picked = docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string"))
    pieces = common.staged(spark, picked.mapInArrow(_cut(path, end_id, size), PIECES), "pieces")
    found = common.staged(spark, pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in found.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = found.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(_assign(places(best_two_fit(counts, size))), PACKED)
