"""How the sources of a language differ in their words: exact divergences over run-length columns.

Counts per (lang, source, term) make a matrix per language, with a row for each kept term and a column for each source.
Rows are reordered by their counts, so that equal ones are neighbours, and dealt to blocks by ranges of that order.
In a block every column is run-length encoded: a stretch of terms with the same count is one run, and zeros are runs
too. For two columns the boundaries of their runs are intersected; between two boundaries the divergence f of
a term is the same for all terms, and is multiplied by their number.

All arithmetic is on integers. Where a share's numerator is over 63 bits, Python's integers are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import common

#: The fewest documents of a kept term, and the unit of a share.
FEWEST, ONE, SMOOTH = 10, 1_000_000_000, 2
#: Of each byte of a text in UTF-8: what stands for it in a term. Terms are letters of ASCII, in lower case, and all
#: characters beyond ASCII; every other byte is a gap.
_IN_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a block of terms holds, at most, and (term, source) pairs that a task keeps before it passes them on.
BLOCK, KEPT = 1_000_000, 500_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed over many documents of a task."""
    times: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> pa.RecordBatch:
        rows = [(*group, term.decode(), k, docs[term]) for group, (n, docs) in times.items() for term, k in n.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        names = ["lang", "source", "term", "n", "docs"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = times.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            terms = text.encode().translate(_IN_TERM).split()
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size > KEPT:
                yield flushed()
                times, size = {}, 0
    yield flushed()


def term_counts(docs: DataFrame, lang_column="lang", source_column="source", text_column="text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term. Nulls count as ''."""
    picked = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_column, source_column, text_column)]
    part = docs.select(*picked).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    whole = total + SMOOTH * terms
    if len(counts) and (int(counts.max()) + SMOOTH) * ONE >= 1 << 63 or whole >= 1 << 63:
        return np.array([1 + ONE * (int(c) + SMOOTH) // whole for c in counts], dtype=np.int64)
    return 1 + (ONE * (counts.astype(np.int64) + SMOOTH)) // whole


def encoded(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A column's runs as (start, count): from the places with a count over zero, in ascending order, of `length`."""
    column_starts, column_counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    if len(places):
        broken = np.r_[True, (places[1:] != places[:-1] + 1) | (counts[1:] != counts[:-1])]
        first = np.flatnonzero(broken)
        last = np.r_[first[1:], len(places)] - 1
        gap = places[last] + 1 < np.r_[places[first[1:]], length]  # zeros after the run
        column_starts += [places[first], places[last][gap] + 1]
        column_counts += [counts[first], np.zeros(int(gap.sum()), np.int64)]
    starts, values = np.concatenate(column_starts), np.concatenate(column_counts)
    order = np.argsort(starts, kind="stable")
    starts, values = starts[order], values[order]
    final = np.r_[starts[1:] != starts[:-1], True]  # of equal starts the later run; the other is empty
    return starts[final], values[final]


def divergence(one: tuple, other: tuple, length: int) -> int:
    """Sum of f = floor((p - q)^2 / (p + q)) over `length` terms, for two columns of (run start, share)."""
    starts = np.union1d(one[0], other[0])
    p = one[1][np.searchsorted(one[0], starts, side="right") - 1]
    q = other[1][np.searchsorted(other[0], starts, side="right") - 1]
    f = (p - q) * (p - q) // (p + q)
    times = np.diff(np.r_[starts, length])
    return int(f @ times) if int(f.max(initial=0)) * length < 1 << 62 else sum(map(int.__mul__, f.tolist(), times.tolist()))


_RUNS = "lang string, block bigint, source string, length bigint, starts array<bigint>, counts array<bigint>"
_RUN_TYPES = pa.schema(
    [("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("length", pa.int64()),
     ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the matrix in their order come in; the run-length columns of each block go out."""
    from pyspark import TaskContext

    part, serial = TaskContext.get().partitionId(), 0
    lang, length, size, columns = None, 0, 0, {}

    def block() -> pa.RecordBatch:
        rows = []
        for source, (places, counts) in columns.items():
            starts, values = encoded(np.array(places), np.array(counts), length)
            rows.append((lang, part << 32 | serial, source, length, starts, values))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUN_TYPES, strict=True)], schema=_RUN_TYPES
        )

    for batch in batches:
        for here, vector in zip(batch.column("lang").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            if length and (here != lang or size >= BLOCK):
                yield block()
                serial, length, size, columns = serial + 1, 0, 0, {}
            lang = here
            for entry in vector:
                places, counts = columns.setdefault(entry["source"], ([], []))
                places.append(length)
                counts.append(entry["n"])
            length += 1
            size += len(vector)
    if length:
        yield block()


_PAIR_TYPES = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _pairs(runs: pa.Table, groups: pa.Table) -> pa.Table:
    """The part of each pair's divergence that a block holds, for every two sources of its language."""
    if not runs.num_rows or not groups.num_rows:
        return _PAIR_TYPES.empty_table()
    length = runs.column("length")[0].as_py()
    given = {r["source"]: (np.array(r["starts"]), np.array(r["counts"])) for r in runs.to_pylist()}
    empty = np.zeros(1, np.int64)
    columns = {}
    for group in groups.to_pylist():
        starts, counts = given.get(group["source"], (empty, empty))
        columns[group["source"]] = starts, shares(counts, group["total"], group["terms"])
    lang, names = runs.column("lang")[0].as_py(), sorted(columns)
    rows = [
        (lang, a, b, divergence(columns[a], columns[b], length)) for i, a in enumerate(names) for b in names[i + 1 :]
    ]
    found = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(found, _PAIR_TYPES, strict=True)], schema=_PAIR_TYPES)


def _share(n: Column, total: Column, terms: Column) -> Column:
    number = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = number(F.lit(ONE), 10) * number(n + SMOOTH, 20)
    return F.lit(1) + F.call_function("div", top, number(total + SMOOTH * terms, 20))


def audit(
    spark: SparkSession, docs: DataFrame, lang_column="lang", source_column="source", text_column="text", top: int = 10
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others, and its most typical terms.

    Part `pair` has a row for every other source of the language, the most different first. Part `term` has the `top`
    terms whose share in the source is over that in the language. Null lang, source and text count as ''. A source whose
    texts are empty has counts of zero and takes part; a language without kept terms has pairs of value 0 and
    no terms. Ties are broken by the item's bytes. Repeated rows count each. An empty table gives no rows; other
    columns are not read.
    """
    common.ready_workers(spark)
    counts = common.staged(spark, term_counts(docs, lang_column, source_column, text_column), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
    kept = kept.where(F.col("docs") >= FEWEST).select("lang", "term", "all_n")
    matrix = common.staged(spark, counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "matrix")

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_column, "lang"), (source_column, "source"))]
    occurring = docs.select(*named).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    totals = matrix.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = common.staged(spark, groups.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups")

    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    vectors = common.staged(spark, matrix.groupBy("lang", "term").agg(vector), "vectors")
    order = [F.col("lang"), F.col("vector"), F.col("term")]
    ordered = vectors.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "vector")
    runs = common.staged(spark, ordered.mapInArrow(_columns, _RUNS), "runs")
    blocks = runs.select("lang", "block").distinct()
    beside = blocks.join(groups, "lang").select(
        F.col("lang").alias("in_lang"), F.col("block").alias("in_block"), "source", "total", "terms"
    )
    by_block = runs.groupBy("lang", "block").cogroup(beside.groupBy("in_lang", "in_block"))
    parts = by_block.applyInArrow(_pairs, "lang string, a string, b string, value bigint")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    wanted = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang")
    pairs = wanted.where(F.col("a") != F.col("b")).join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), zero("value")
    )

    shared = matrix.join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    q = _share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q")
    typical = shared.select("lang", "source", "term", p, q).where("p > q")
    f = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    typical = typical.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f.alias("value"))

    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = typical.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(group)).unionByName(best)
