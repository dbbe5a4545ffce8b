"""Exact duplicates by a stateful stream: which row of equal texts stays.

Documents are staged as (digest, id, locator) and streamed into keyed state, kept by RocksDB on the executors' disks
and saved in the shared folder. The state of a digest never expires. It holds the count, and the identifier and
locator of the row that stays so far. Copies that arrive together are reduced in their own task before the shuffle,
so a text with a third of all rows is a few rows per batch for its state.

A digest that was seen before only makes a row a candidate: the bytes under each digest are compared, as their least
and greatest, which tasks reduce before one shuffle. Rows that differ are grouped by their bytes. The locator says in
which file the row that stays is found.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common

STATE_STORE = "spark.sql.streaming.stateStore"
#: State on disk; its files take the space they need, not what they might, as there is one store per partition.
SETTINGS = {
    f"{STATE_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE_STORE}.rocksdb.allowFAllocate": "false",
    f"{STATE_STORE}.rocksdb.blockCacheSizeMB": "1",
    f"{STATE_STORE}.rocksdb.writeBufferSizeMB": "4",
    f"{STATE_STORE}.unloadOnCommit": "true",  # the next stages need the memory
}
DIGESTS = "digest binary, n_bytes bigint, doc_id bigint, file string"


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fed(spark: SparkSession, arrivals: str, state: str, batch_bytes: int = 64 << 30) -> None:
    """Runs the stream over all files of digests in `arrivals` that `state` hasn't seen, in batches of bounded size.

    `state` is a checkpoint: run again after a failure or after new files came, it goes on where it was.
    """
    with _set(spark, SETTINGS):
        stream = spark.readStream.schema(DIGESTS).option("maxBytesPerTrigger", batch_bytes).parquet(arrivals)
        stays = F.max(F.struct("doc_id", "file"))
        kept = stream.groupBy("digest", "n_bytes").agg(stays.alias("stays"), F.count("*").alias("n"))
        query = (
            kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def retained(spark: SparkSession, state: str) -> DataFrame:
    """The state: digest, n_bytes, keep_id, keep_file, n."""
    stored = spark.read.format("statestore").load(state).select("key.*", "value.*")
    stays, n = stored.columns[2:4]
    return stored.select(
        "digest", "n_bytes", F.col(f"{stays}.doc_id").alias("keep_id"), F.col(f"{stays}.file").alias("keep_file"),
        F.col(n).alias("n"),
    )


def duplicates(
    spark: SparkSession, docs: DataFrame, id_column="doc_id", text_column="text", digest=sha256,
    batch_bytes: int = 64 << 30,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; nothing is normalised. Null texts count as empty and are copies of each
    other and of empty ones. Of equal texts the largest id stays. Rows repeated with their id count in group_size and
    are all marked alike. A null id is smaller than any other; it stays only if its group has no other, and as
    keep_id is then null too. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    picked = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"), F.input_file_name().alias("file")
    )
    arrivals, state = common.scratch(spark, "digests"), common.scratch(spark, "seen")
    hashed = picked.select(
        digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"), "doc_id", "file",
        sha256(F.col("text")).alias("sha"),
    )
    hashed.write.parquet(arrivals)
    fed(spark, arrivals, state, batch_bytes)
    groups = common.staged(spark, retained(spark, state), "groups")
    several = groups.where("n > 1")
    known = spark.read.schema(f"{DIGESTS}, sha binary").parquet(arrivals)
    marked = known.select("digest", "n_bytes", "doc_id", "sha").join(several, ["digest", "n_bytes"], "left")
    group_size = F.coalesce("n", F.lit(1)).cast("bigint")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    result = marked.select(
        "doc_id", keep.alias("keep_id"), group_size.alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"),
        "digest", "n_bytes",
    )

    strangers = common.staged(spark, _strangers(picked, digest), "strangers")
    if not strangers.isEmpty():  # different texts under one digest: by their bytes, then
        result = _regrouped(result, picked, strangers, digest)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return result.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _strangers(picked: DataFrame, digest) -> DataFrame:
    """Digests with rows of different bytes. Tasks keep two texts of each digest, so frequent ones are few rows."""
    length = F.octet_length("text").cast("bigint")
    under = picked.groupBy(digest(F.col("text")).alias("digest"), length.alias("n_bytes"))
    return under.agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select(
        "digest", "n_bytes"
    )


def _regrouped(result: DataFrame, picked: DataFrame, strangers: DataFrame, digest) -> DataFrame:
    keys = ["digest", "n_bytes"]
    rows = picked.select(
        "doc_id", "text", digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")
    ).join(strangers, keys, "left_semi")
    groups = rows.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = rows.join(groups, "text").select(
        "doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), *keys
    )
    return result.join(strangers, keys, "left_anti").unionByName(again)


def deduplicated(
    spark: SparkSession, docs: DataFrame, id_column="doc_id", text_column="text", **options
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Of equal texts the rows with the largest id stay, and of rows that repeat an id and text one; other texts under
    the same id are judged on their own. Null and empty texts are equal. A null id stays where its text has no other.
    """
    found = duplicates(spark, docs, id_column, text_column, **options)
    found = common.staged(spark, found.select("doc_id", "text_sha256", "kept"), "decisions")
    names = ("own_id", "own_digest", "decided_id", "decided_digest")
    key, digest, other_key, other_digest = (common.free_name(docs, name) for name in names)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    marked = docs.withColumns({key: F.col(id_column).cast("bigint"), digest: F.sha2(text, 256)})

    def among(rows: DataFrame, decided: DataFrame, how: str) -> DataFrame:
        named = decided.select(F.col("doc_id").alias(other_key), F.col("text_sha256").alias(other_digest)).distinct()
        same = F.col(key).eqNullSafe(F.col(other_key)) & (F.col(digest) == F.col(other_digest))
        return rows.join(named, same, how)

    stay = among(marked, found.where("not kept"), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    again = common.staged(spark, again, "repeated")
    if not again.isEmpty():
        once = among(stay, again, "left_semi").dropDuplicates([key, digest])
        stay = among(stay, again, "left_anti").unionByName(once)
    return stay.select(*docs.columns)
