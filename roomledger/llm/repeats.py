"""Repeated passages by prefix-partitioned suffix trees over words.

Every word of a text starts a suffix. Of the first `words` words of a suffix, the run of RUN words with the least hash
is its anchor, and the suffix's prefix reaches to the end of that run: prefixes have different lengths, equal
beginnings have equal prefixes, and neighbouring suffixes with one anchor share the end of theirs, so that they are
shipped together, as one segment of text. Anchors are counted over all texts first. A suffix whose anchor is found
nowhere else is a leaf next to the root and goes no further; the others are dealt by anchor, and tasks take as many
anchors in a row as fit in memory.

There the suffixes of all segments are sorted by prefix doubling, and the ranks of each doubling give the length of
the words that neighbours share. The sorted suffixes with these lengths are the group's suffix tree; a node of at
least `words` words is a repeat, and the longest one above a leaf is the longest repeat that starts there.

An anchor with more than LARGEST occurrences would be too large a group. Its prefixes are extended to `words` words,
the depth at which a node is a repeat as soon as it has two leaves. Only their number is needed, which is
aggregated before the shuffle; nodes with one leaf are taken back.

Texts of equal words are one text with a number of copies. Texts are kept in a table bucketed by their key, so that
positions come back to them without another shuffle of the texts.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common
from roomledger.llm.tokens import slices

#: Words of an anchor, at most; a third of the window.
RUN = 12
#: Occurrences of an anchor up to which its suffixes are sorted in one task.
LARGEST = 1000
#: Bytes of segments that are sorted together.
GROUP_BYTES = 8 << 20
_PLACE = np.uint64((1 << 30) - 1)
_U = np.uint64
_ODD, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(29))


class _Hashes:
    """64-bit hashes of words, kept between texts of a task."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(text, first, n, anchor): runs of neighbouring window starts with one anchor, for texts one after another.

    `hashes` are those of all words of the texts, `lengths` their numbers of words; `first` counts in its text.
    """
    run = min(RUN, -(-words // 3))
    windows, choices = len(hashes) - words + 1, words - run + 1
    if windows < 1:
        return (np.empty(0, np.int64),) * 4
    runs = np.zeros(len(hashes) - run + 1, dtype=np.uint64)
    for i in range(run):
        runs *= _ODD
        runs += hashes[i : i + len(runs)]
    runs = _mixed(runs)
    least = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)  # of equal ones the first
    span = 1
    while 2 * span <= choices:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[choices - span : choices - span + windows])
    bounds = np.cumsum(lengths)
    inside = np.flatnonzero(np.repeat(bounds, lengths)[:windows] - np.arange(windows) >= words)  # in one text
    if not len(inside):
        return (np.empty(0, np.int64),) * 4
    at = (least[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # texts have places of their own
    text = np.searchsorted(bounds, at[first], side="right")
    starts = inside[first] - (bounds - lengths)[text]
    return text, starts, np.diff(np.r_[first, len(at)]), runs[at[first]].view(np.int64)


def suffix_tree(symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in order, and how many symbols each shares with the one before it.

    `symbols` holds segments one after another; ends[i] is where the segment of place i ends, and so all its suffixes.
    Depths between neighbours describe the suffix tree: a node is a stretch of suffixes that share its depth.
    """
    places = np.arange(len(symbols))
    longest = int((ends - places).max())
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1]
    length = 1

    def further(by: np.ndarray, rank: np.ndarray, step: int) -> np.ndarray:
        inside = by + step < ends[by]
        return np.where(inside, rank[np.minimum(by + step, len(rank) - 1)], 0)

    while 2 * length < longest:
        pair = ranks[-1] * (len(symbols) + 2) + further(places, ranks[-1], length)
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1)
        length *= 2
    key = ranks[-1][starts] * (len(symbols) + 2) + further(starts, ranks[-1], length)
    order = starts[np.argsort(key, kind="stable")]
    one, other = order[:-1], order[1:]
    shared = np.zeros(len(one), dtype=np.int64)
    for level in [len(ranks) - 1, *range(len(ranks) - 1, -1, -1)]:
        a, b = one + shared, other + shared
        inside = (a < ends[one]) & (b < ends[other])
        a, b = np.minimum(a, len(symbols) - 1), np.minimum(b, len(symbols) - 1)
        shared += np.where(inside & (ranks[level][a] == ranks[level][b]), 1 << level, 0)
    shared = np.minimum(shared, np.minimum(ends[one] - one, ends[other] - other))
    return order, np.r_[0, shared] if len(order) else shared


def deep_nodes(segments: list[bytes], n_starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end): of each segment with a repeat, the words that its repeats cover.

    The first n_starts[i] words of segment i start suffixes. Two starts in a segment are less than `words` apart, so
    their repeats of at least `words` words leave no gap.
    """
    found = b" ".join(segments).split()
    ids = {word: i for i, word in enumerate(dict.fromkeys(found))}
    symbols = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
    sizes = n_starts + words - 1
    bounds = np.cumsum(np.r_[0, sizes])
    owner = np.repeat(np.arange(len(segments)), sizes)
    starts = np.flatnonzero(np.arange(len(symbols)) - bounds[owner] < n_starts[owner])
    order, shared = suffix_tree(symbols, bounds[1:][owner], starts)
    longest = np.maximum(shared, np.r_[shared[1:], 0])
    deep = longest >= words
    at, end = order[deep], order[deep] + longest[deep]
    if not len(at):
        return at, at, at
    by_place = np.argsort(at, kind="stable")
    at, end = at[by_place], end[by_place]
    segment = owner[at]
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    segment = segment[first]
    return segment, at[first] - bounds[segment], np.maximum.reduceat(end, first) - bounds[segment]


def _anchored(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in slices(batch.column(1)):
                found = [text.encode().split() for text in texts]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                flat = hashes.of(list(itertools.chain.from_iterable(found)))
                text, first, n, anchor = anchors(flat, lengths, words)
                columns = [pa.array(anchor, pa.int64()), keys.take(pa.array(text + at, pa.int64()))]
                columns += [pa.array(x.astype(np.int32), pa.int32()) for x in (first, n)]
                yield pa.record_batch(columns, names=["anchor", "key", "first", "n"])
                at += len(texts)

    return run


def _segments(words: int):
    """One row per live anchor of a text: its words from the first suffix's start to the last one's reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, live in zip(*(batch.column(c) for c in ("key", "text", "live")), strict=True):
                found = text.as_py().encode().split()
                for at in live.as_py():
                    a, n = at["first"], at["n"]
                    rows.append((at["anchor"], key.as_py(), a, n, b" ".join(found[a : a + n + words - 1])))
                if len(rows) > 20_000:
                    yield _batch(rows, _SEGMENTS)
                    rows = []
            yield _batch(rows, _SEGMENTS)

    return run


_SEGMENTS = pa.schema(
    [("anchor", pa.int64()), ("key", pa.binary()), ("first", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]
)
_NODES = pa.schema([("node", pa.binary()), ("key", pa.binary()), ("first", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _nodes(words: int):
    """One row per suffix below a frequent anchor: its node at the depth of a repeat, by a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, live in zip(*(batch.column(c) for c in ("key", "text", "live")), strict=True):
                found, key = text.as_py().encode().split(), key.as_py()
                for at in live.as_py():
                    for i in range(at["first"], at["first"] + at["n"]):
                        rows.append((xxhash.xxh3_128_digest(b" ".join(found[i : i + words])), key, i))
                if len(rows) > 20_000:
                    yield _batch(rows, _NODES)
                    rows = []
            yield _batch(rows, _NODES)

    return run


def _trees(words: int):
    """Sorted by anchor, segments come in; what repeats in them goes out, as (key, first, end) in the text."""

    def grouped(group: pa.Table) -> pa.RecordBatch:
        first, n = (group.column(c).to_numpy().astype(np.int64) for c in ("first", "n"))
        segment, a, b = deep_nodes(group.column("words").to_pylist(), n, words)
        keys = group.column("key").take(pa.array(segment)).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) and keys.num_chunks else keys
        spans = [pa.array((first[segment] + x).astype(np.int32)) for x in (a, b)]
        return pa.record_batch([pa.array(keys.to_pylist(), pa.binary()), *spans], names=["key", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < GROUP_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if not len(cuts):
                continue
            start, per_row = 0, size / len(anchor)
            wanted = np.arange(1, size // GROUP_BYTES) * GROUP_BYTES / per_row
            for cut in [*cuts[np.minimum(np.searchsorted(cuts, wanted), len(cuts) - 1)], cuts[-1]]:
                if cut > start:
                    yield grouped(table.slice(start, cut - start))
                    start = cut
            held = table.slice(start).to_batches()
            size = int(per_row * (len(anchor) - start))
        if held:
            yield grouped(pa.Table.from_batches(held))

    return run


def _cut(words: int):
    """Per text: its words, how many of them repeats cover, and the digest of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c) for c in ("key", "text", "copies", "found"))
            for key, text, copies, found in zip(*columns, strict=True):
                all_words = text.as_py().encode().split()
                gone = covered(len(all_words), words, copies.as_py(), found.as_py() or [])
                left = all_words
                if gone.any():
                    left = [word for word, is_gone in zip(all_words, gone.tolist(), strict=True) if not is_gone]
                digest = hashlib.sha256(b" ".join(left)).hexdigest()
                rows.append((key.as_py(), len(all_words), len(all_words) - len(left), digest))
            yield _batch(rows, _RESULT)

    return run


_RESULT = pa.schema(
    [("key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)


def covered(n_words: int, words: int, copies: int, found: list[dict]) -> np.ndarray:
    """Which words of a text repeats cover: `span`s of words, `claim`ed ranges of starts, without the `single` ones."""
    if copies > 1 and n_words >= words:
        return np.ones(n_words, dtype=bool)
    starts = np.zeros(n_words + 1, dtype=bool)
    change = np.zeros(n_words + 1, dtype=np.int64)
    for at in found:
        if at["kind"] == "claim":
            starts[at["first"] : at["end"]] = True
    for at in found:
        if at["kind"] == "single":
            starts[at["first"]] = False
        elif at["kind"] == "span":
            change[at["first"]] += 1
            change[at["end"]] -= 1
    claimed = np.flatnonzero(starts)
    change[claimed] += 1
    change[claimed + words] -= 1
    return np.cumsum(change)[:n_words] > 0


def word_key(text: Column) -> Column:
    """Half the SHA-256 of a text's words, joined by one space."""
    plain = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.substring(F.unhex(F.sha2(plain, 256)), 1, 16)


def _texts(spark: SparkSession, picked: DataFrame) -> DataFrame:
    """(key, text, copies), a row for all texts of equal words, in a table bucketed by key."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = picked.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"roomledger_texts_{uuid.uuid4().hex}"
    texts.write.format("parquet").bucketBy(n, "key").option("path", common.scratch(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _per_text(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("live"))


def repeats(spark: SparkSession, texts: DataFrame, words: int) -> DataFrame:
    """(key, kind, first, end): what repeats in the texts, as `covered` reads it, for texts of distinct words."""
    found = texts.select("key", "text").mapInArrow(_anchored(words), "anchor bigint, key binary, first int, n int")
    found = common.staged(spark, found, "anchors")
    several = found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1")
    several = common.staged(spark, several, "several")  # a plain shuffle on both sides lets a frequent anchor be split
    live = common.staged(spark, found.join(several, "anchor"), "live")
    usual, frequent = live.where(F.col("times") <= LARGEST), live.where(F.col("times") > LARGEST)

    def with_text(rows: DataFrame) -> DataFrame:
        return texts.select("key", "text").join(_per_text(rows, "anchor", "first", "n"), "key")

    segments = with_text(usual).mapInArrow(
        _segments(words), "anchor bigint, key binary, first int, n int, words binary"
    )
    dealt = segments.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    spans = dealt.mapInArrow(_trees(words), "key binary, first int, end int")

    nodes = with_text(frequent).mapInArrow(_nodes(words), "node binary, key binary, first int")
    leaves = nodes.groupBy("node").agg(
        F.count("*").alias("leaves"), F.min("key").alias("key"), F.min("first").alias("first")
    )
    single = leaves.where("leaves = 1").select("key", "first", (F.col("first") + 1).alias("end"))
    claims = frequent.select("key", "first", (F.col("first") + F.col("n")).alias("end"))

    def kind(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("key", F.lit(name).alias("kind"), "first", "end")

    return kind(spans, "span").unionByName(kind(single, "single")).unionByName(kind(claims, "claim"))


def without_repeats(
    spark: SparkSession, docs: DataFrame, words: int = 35, id_column="doc_id", text_column="text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by one space.

    A word goes if some `words` consecutive words around it are also found elsewhere, in another document or
    at another place of the same one. Words are runs of other characters than ASCII white space, and unchanged. Every
    occurrence goes, the first as well. Null, empty and white-space texts have no words; texts with fewer than `words`
    words lose none. Repeated rows are copies of each other, with or without an id; each gets its row. An empty
    table gives no rows; other columns are not read.
    """
    common.ready_workers(spark)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"))
    picked = picked.select("doc_id", "text", word_key(F.col("text")).alias("key"))
    texts = _texts(spark, picked)
    found = common.staged(spark, repeats(spark, texts, words), "repeats")
    found = found.groupBy("key").agg(F.collect_list(F.struct("kind", "first", "end")).alias("found"))
    result = "key binary, n_words bigint, n_removed bigint, kept_sha256 string"
    cut = texts.join(found, "key", "left").select("key", "text", "copies", "found").mapInArrow(_cut(words), result)
    rows = picked.select("doc_id", "key").join(cut, "key")
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")
