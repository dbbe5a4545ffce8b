"""Near-duplicates: a Hamming join over b-bit MinHash signatures by several indexes, links confirmed on full sets.

A signature is 48 values of 16 bits. It is split into 12 chunks of 4 values. Two signatures that differ in at most 23
values have, by the pigeonhole principle, a chunk in which at most one value differs; enumerating that error, each
chunk is indexed four times, leaving out one value each time. So every such pair meets under some key. A pair of
sets at similarity 0.8 misses all 12 chunks with a probability of about 1e-9, at 0.85 of 3e-12.

Documents with one set are one node, numbered on its own, so that ids need not tell texts apart. Under each key, all nodes are assigned to the smallest one there, the hub, so a
key with very many nodes gives one row for each, and no pairs. All pairs that meet under a key meet in its hub's
group. A group is one task's work, which counts shingles in common and returns links that connect what is
connected, not every link.

A group whose sets are over a size is dealt to blocks. In each, sets are compared with a few representatives of the
group first; sets that are linked with the same one, or with two that are connected, need no comparison among
themselves. All but the largest such part of the group is compared with the whole group, each block of it with each block
of the group. Copies of one text are all in that part, so that their number adds to the work as it is, not as its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import common, graph

CHUNKS, IN_CHUNK = 12, 4
VALUES = CHUNKS * IN_CHUNK
#: Differing values up to which a pair is sure to meet.
DISTANCE = 2 * CHUNKS - 1
#: Shingles of a group that one block holds.
BLOCK = 2_000_000
#: Sets of a large group that all others are compared with first.
REPRESENTATIVES = 8
_U = np.uint64
_GOLDEN, _MIX = _U(0x9E3779B97F4A7C15), (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


_MULTIPLIERS = _mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * _GOLDEN) | _U(1)


class Words:
    """Hashes of words, kept for the words of a task's texts."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # on bytes: only A-Z, and only the white space of ASCII
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; of fewer words, one for all of them."""
    if not len(words):
        return words
    size = min(size, len(words))
    run = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        run = _mixed(run * _GOLDEN + words[i : len(words) - size + 1 + i] + _U(size))
    return np.unique(run)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit minima under 48 hash functions, a row for each non-empty set."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    least = np.empty((len(sets), VALUES), dtype="<u2")
    for j, factor in enumerate(_MULTIPLIERS):
        least[:, j] = (_mixed(np.minimum.reduceat(flat * factor, starts)) & _U(0xFFFF)).astype("<u2")
    return least


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_held()
        words = Words()
        for batch in batches:
            sets = [shingles(words.hashes(text.as_py() or ""), size) for text in batch.column(1)]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            signatures: list = [None] * len(sets)
            for a in range(0, len(full), 500):
                part = full[a : a + 500]
                for i, row in zip(part, signature([sets[i] for i in part]), strict=True):
                    keys[i], signatures[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signatures, pa.binary()), batch.column(2)],
                names=["doc_id", "n_shingles", "set_key", "signature", "text_key"],
            )

    return run


def _sets(size: int):
    """The sets of texts, under the numbers of those among `wanted` that they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_held()
        words = Words()
        for batch in batches:
            nodes, sets = [], []
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = shingles(words.hashes(text.as_py() or ""), size).tobytes()
                key = xxhash.xxh3_128_digest(found)
                for node in {w["node"] for w in wanted if w["set_key"] == key}:
                    nodes.append(node)
                    sets.append(found)
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _keys():
    """One key per chunk and value left out: a hash of the chunk's other values, the chunk and the place."""
    for chunk in range(CHUNKS):
        values = [F.substring("signature", 1 + 2 * (chunk * IN_CHUNK + i), 2) for i in range(IN_CHUNK)]
        for out in range(IN_CHUNK):
            yield F.xxhash64(F.lit(chunk * IN_CHUNK + out), *[v for i, v in enumerate(values) if i != out])


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with 100 * intersection >= percent * union, enough to connect all that such pairs connect."""
    sizes = np.array([len(s) for s in sets])
    alive = np.arange(len(sets))
    while len(alive) > 1:  # a set with too many shingles of its own has no link
        flat = np.concatenate([sets[i] for i in alive])
        owner = np.repeat(np.arange(len(alive)), sizes[alive])
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        common_n = np.bincount(owner[shared], minlength=len(alive))
        stay = 100 * common_n >= percent * sizes[alive]
        if stay.all():
            break
        alive = alive[stay]
    if len(alive) < 2:
        return []
    order = np.argsort(column, kind="stable")
    holders, starts = owner[order], np.cumsum(np.r_[0, times])
    own = np.cumsum(np.r_[0, sizes[alive]])
    n = len(alive)
    parent = np.arange(n)  # of each its component's smallest number
    links = []
    size = sizes[alive]
    done = np.zeros(n, dtype=bool)

    def link(i: int) -> None:
        todo = ~done & (parent != parent[i])
        todo &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
        done[i] = True
        if not todo.any():
            return
        mine = column[own[i] : own[i + 1]]
        lengths = times[mine]
        at = np.repeat(starts[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        inter = np.bincount(holders[at], minlength=n)
        for j in np.flatnonzero(todo & (100 * inter >= percent * (size + size[i] - inter))):
            if parent[i] != parent[j]:
                links.append((int(alive[i]), int(alive[j])))
                low, high = sorted((parent[i], parent[j]))
                parent[parent == high] = low

    link(int(np.argmax(np.bincount(owner, weights=times[column], minlength=n))))  # the most typical first
    in_component = np.bincount(parent, minlength=n)[parent]
    for i in np.argsort(in_component, kind="stable"):  # then those it is not linked with, against all
        link(int(i))
    return links


def _linked(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        pairs = links_within(sets, percent)
        return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64")

    return run


def _similar(inter, one, other, percent: int):
    return 100 * inter >= percent * (one + other - inter)


class _Holders:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that are similar to `one`."""
        first, last = (np.searchsorted(self.shingles, one, side=side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        inter = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((inter > 0) & _similar(inter, len(one), self.sizes, percent))


def _labelled(percent: int):
    """Each set of a block with all representatives that it is linked with."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        leads = group["lead"].to_numpy()
        others, first = group[~leads], group[leads].sort_values("node")
        found: list[list[int]] = [[] for _ in range(len(others))]
        if len(others):
            holders = _Holders([np.frombuffer(s, np.uint64) for s in others["shingles"]])
            for node, shingles_of in zip(first["node"].tolist(), first["shingles"], strict=True):
                for i in holders.similar(np.frombuffer(shingles_of, np.uint64), percent):
                    found[i].append(node)
        leads = pd.Series(found, index=others.index, dtype=object)
        return pd.DataFrame({"hub": others["hub"], "node": others["node"], "leads": leads})

    return run


def _connected(group: pd.DataFrame) -> pd.DataFrame:
    """The representatives of a group, each with the smallest it is connected with by sets linked to both."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            node = parent[node]
        return node

    for leads in group["leads"]:
        roots = sorted(map(root, leads))
        for other in roots[1:]:
            parent[root(other)] = root(roots[0])
    least: dict[int, int] = {}
    for node in sorted(parent):
        least.setdefault(root(node), node)
    nodes = sorted(parent)
    hubs = [group["hub"].iloc[0]] * len(nodes)
    return pd.DataFrame({"hub": hubs, "first": nodes, "label": [least[root(n)] for n in nodes]}, dtype="int64")


def _rest_linked(percent: int):
    """Links of a block of sets with a block of their group. Sets with one label are known to be connected."""

    def run(rest: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(rest) and len(block):
            holders = _Holders([np.frombuffer(s, np.uint64) for s in block["shingles"]])
            nodes, labels = block["node"].tolist(), [None if pd.isna(x) else int(x) for x in block["label"]]
            parent: dict[int, int] = {}

            def root(node: int) -> int:
                while parent.get(node, node) != node:
                    node = parent[node]
                return node

            own = [node if pd.isna(x) else int(x) for node, x in zip(rest["node"].tolist(), rest["label"], strict=True)]
            for node, known, shingles_of in zip(rest["node"].tolist(), own, rest["shingles"], strict=True):
                for i in holders.similar(np.frombuffer(shingles_of, np.uint64), percent):
                    other = nodes[i] if labels[i] is None else labels[i]  # a label stands for all that have it
                    low, high = sorted((root(known), root(other)))
                    if low != high:
                        parent[high] = low
                        a.append(node)
                        b.append(nodes[i])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def _links_of_large(spark: SparkSession, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within groups of several blocks. `member` has hub, node, n and the group's number of `blocks`."""
    place = Window.partitionBy("hub").orderBy(F.xxhash64("hub", "node"), "node")
    leads = member.withColumn("place", F.row_number().over(place)).where(F.col("place") <= REPRESENTATIVES)
    leads = leads.select("hub", "node", "n", "blocks")  # at most REPRESENTATIVES rows of each group
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    dealt = member.select("hub", "node", block.alias("block"), F.lit(False).alias("lead"))
    dealt = dealt.unionByName(leads.select("hub", "node", every("blocks").alias("block"), F.lit(True).alias("lead")))
    compared = dealt.join(sets, "node").groupBy("hub", "block")
    linked = compared.applyInPandas(_labelled(percent), "hub bigint, node bigint, leads array<bigint>")
    linked = common.staged(spark, linked, "linked")
    distinct = linked.where(F.size("leads") > 0).select("hub", "leads").distinct()  # at most 2 ** REPRESENTATIVES a group
    roots = distinct.groupBy("hub").applyInPandas(_connected, "hub bigint, first bigint, label bigint")
    labels = linked.withColumn("first", F.try_element_at("leads", F.lit(1))).join(roots, ["hub", "first"], "left")
    labels = common.staged(spark, labels.join(member, ["hub", "node"]), "labels")

    sizes = labels.where("label is not null").groupBy("hub", "label").count()
    largest = sizes.groupBy("hub").agg(F.max_by("label", "count").alias("largest"))
    rest = labels.join(largest, "hub", "left").where(~F.col("label").eqNullSafe(F.col("largest")) | F.col("label").isNull())
    rest = common.staged(spark, rest.select("hub", "node", "n", "label", "blocks"), "rest")
    rest_blocks = F.ceil(F.sum("n") / BLOCK).cast("int").alias("rest_blocks")
    sized = common.staged(spark, rest.groupBy("hub").agg(rest_blocks), "rests")
    own = F.pmod(F.xxhash64("node"), F.col("rest_blocks")).cast("int").alias("part")
    left = rest.join(sized, "hub").select("hub", "node", "label", own, every("blocks").alias("block"))
    right = labels.join(sized, "hub").select("hub", "node", "label", every("rest_blocks").alias("part"), block.alias("block"))
    left = left.join(sets, "node").groupBy("hub", "part", "block")
    renamed = [F.col(c).alias(a) for c, a in (("hub", "of_hub"), ("part", "of_part"), ("block", "of_block"))]
    columns = [F.col(c).alias(c) for c in ("node", "label", "shingles")]  # new ones: both sides come from one table
    right = right.join(sets, "node").select(*renamed, *columns).groupBy("of_hub", "of_part", "of_block")
    found = left.cogroup(right).applyInPandas(_rest_linked(percent), "a bigint, b bigint")
    return linked.select(F.explode("leads").alias("a"), F.col("node").alias("b")).unionByName(found)


def _text_key(text: Column) -> Column:
    """Half the SHA-256 of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_column="doc_id", text_column="text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than ASCII white space, with A-Z in lower case; a document's set holds its
    distinct runs of `words` words, and all its words as one run if it has fewer. Documents are linked when 100 times
    the size of the intersection is at least `percent` times that of the union. component_id is the smallest id
    reached over links, and the document with it is kept. Null and empty texts, and those of white space, have an empty
    set and are linked with nothing. A row with a null id has no links, a null component_id, and is kept. Repeated rows
    are copies of each other: all rows with the smallest id are kept. Rows that share an id but not a text have the
    links of their own texts. An empty table gives no rows.
    """
    return _placed(spark, docs, words, percent, id_column, text_column).drop("text_key")


def _placed(spark: SparkSession, docs: DataFrame, words: int, percent: int, id_column, text_column) -> DataFrame:
    """The rows of `near_duplicates`, with a digest of each one's text."""
    common.ready_workers(spark)
    common.small_batches(spark)
    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, set_key binary, signature binary, text_key binary"
    keyed = picked.withColumn("text_key", _text_key(F.col("text")))
    signed = common.staged(spark, keyed.mapInArrow(_signed(words), schema), "signed")

    nodes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")
    )
    nodes = common.staged(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", "n", F.explode(F.array(*_keys())).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("met")).where("met > 1")
    member = keyed.join(hubs, "key").select("hub", "node", "n").distinct()
    member = common.staged(spark, member, "members")

    blocks = F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    sized = common.staged(spark, member.groupBy("hub").agg(blocks), "groups")
    dealt = common.staged(spark, member.join(sized, "hub"), "dealt")

    # never broadcast: a share of all ids, whatever the size
    met = member.select("node").distinct().join(nodes.select("node", "set_key", "least"), "node")
    wanted = met.groupBy(F.col("least").alias("doc_id")).agg(F.collect_list(F.struct("node", "set_key")).alias("wanted"))
    texts = picked.where("doc_id is not null").join(wanted.hint("merge"), "doc_id")
    texts = texts.dropDuplicates(["doc_id", "text"]).select("text", "wanted")
    sets = texts.mapInArrow(_sets(words), "node bigint, shingles binary").dropDuplicates(["node"])
    sets = common.staged(spark, sets, "sets")
    small = dealt.where("blocks = 1").select("hub", "node").join(sets, "node").groupBy("hub")
    links = small.applyInPandas(_linked(percent), "a bigint, b bigint")
    large = dealt.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_links_of_large(spark, large, sets, percent))
    found = common.staged(spark, graph.components(spark, links), "components")

    linked = nodes.select("node", "set_key", "least").join(found, "node")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = linked.join(smallest, "component").select("set_key", "component_id")
    alone = nodes.join(found, "node", "left_anti").select("set_key", F.col("least").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "text_key", "set_key").join(placed.unionByName(alone), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return rows.select("doc_id", "n_shingles", "text_key", component.alias("component_id"), kept.alias("kept"))


def deduplicated(
    spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_column="doc_id", text_column="text",
) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    Of linked documents those with the smallest id are kept. Null, empty and white-space texts and rows with a null id
    are linked with nothing, and stay. Rows that share an id but not a text are judged each by its own text.
    """
    found = _placed(spark, docs, words, percent, id_column, text_column)
    names = ("own_id", "own_text", "gone_id", "gone_text")
    key, digest, gone_key, gone_digest = (common.free_name(docs, name) for name in names)
    gone = found.where("not kept").select(F.col("doc_id").alias(gone_key), F.col("text_key").alias(gone_digest))
    gone = common.staged(spark, gone.distinct(), "gone")
    marked = docs.withColumns({key: F.col(id_column).cast("bigint"), digest: _text_key(F.col(text_column))})
    same = (F.col(key) == F.col(gone_key)) & (F.col(digest) == F.col(gone_digest))
    return marked.join(gone, same, "left_anti").select(*docs.columns)
