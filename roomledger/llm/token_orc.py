"""Token ids in ORC files: one row per document, in ascending order of ids over all files.

Ids are integers, which ORC stores run-length encoded; every stripe has row indexes, and a Bloom filter on the
document id, so a reader that asks for a few documents skips files, stripes and row groups by metadata alone. A file
is read by several tasks, each at its own stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import common, tokens

ENCODED = "doc_id bigint, ids array<int>"
STRIPE_BYTES, ROWS_PER_INDEX = 16 << 20, 1000


def encode(
    spark: SparkSession, docs: DataFrame, path: str, end_id: int, id_column="doc_id",
    text_column="text",
) -> DataFrame:
    """(doc_id, ids): ids of every whole text by the tokenizer file, and the end id. Null texts count as empty."""
    common.ready_workers(spark)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            done = 0
            for texts in tokens.slices(batch.column(1)):
                got = [ids + end for ids in encoder.encode(texts)]
                flat = np.frombuffer(b"".join(got), "<i4")
                ends = np.cumsum([0, *(len(ids) // 4 for ids in got)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.record_batch([batch.column(0).slice(done, len(texts)), lists], names=["doc_id", "ids"])
                done += len(texts)

    picked = docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string"))
    return picked.mapInArrow(run, ENCODED)


def write(
    spark: SparkSession, docs: DataFrame, path: str, out: str, end_id: int, id_column="doc_id",
    text_column="text",
) -> None:
    """Writes the ids of all documents to the folder `out`.

    Documents are dealt to files by ranges of their id and sorted in each, so files in the order of their smallest id
    hold ascending ids. Documents with equal ids are kept, in the order of their tokens; a null id comes first.
    """
    ordered = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id"))
    written = encode(spark, ordered, path, end_id).sortWithinPartitions("doc_id", "ids")
    options = {
        "orc.stripe.size": STRIPE_BYTES,
        "orc.row.index.stride": ROWS_PER_INDEX,
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": 0.01,
        "compression": "zstd",
    }
    written.write.options(**options).orc(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Rows as written, with the file of each. A filter on doc_id reaches the metadata of files and stripes."""
    return spark.read.schema(ENCODED).orc(out).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        raw, first = flat.tobytes(), 0
        crc = [zlib.crc32(raw[4 * (a - first) : 4 * (b - first)]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(at).astype("i8")), pa.array(crc, pa.int64()), batch.column("file")],
            names=["doc_id", "n_tokens", "ids_crc32", "file"],
        )


def index(spark: SparkSession, out: str) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Running sums are kept within a file; only one row per file is needed to add the files before it. Equal ids in
    one file follow each other in the order of (n_tokens, ids_crc32), which is a defined place for each. An empty
    table gives no rows.
    """
    common.ready_workers(spark)
    sizes = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string"
    rows = common.staged(spark, read(spark, out).mapInArrow(_sizes, sizes), "orc-index")
    files = rows.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy(F.col("least").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("before"))
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32"]
    inside = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    start = (F.col("before") + F.col("inside")).alias("start")
    return summed.join(files, "file").select("doc_id", start, "n_tokens", "ids_crc32")
