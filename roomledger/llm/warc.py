"""WARC archives with a Zstandard dictionary: written by tasks to the shared folder, and read back.

Each archive starts with a skippable frame that holds a dictionary. It is trained once per write, on slices of records
chosen by a hash among all; only if these are too few or too small to train on, there is none. Every record is a frame of its own, so one record can be read without the others. Of equal payloads one record is the response, and
the others are revisits: HTTP headers without the payload, which name the record they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common

#: Fixed values of the file format.
DICTIONARY_FRAME, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:roomledger:page:"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Slices that a write's dictionary is trained on, bytes of each, and of the dictionary.
SLICES, SLICE_BYTES, DICTIONARY_BYTES = 1000, 2 << 10, 32 << 10
#: Bytes of first records that a writer trains on if it is given no dictionary.
SAMPLE_BYTES = 2 << 20
ARCHIVE_BYTES = 1 << 30
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def record(page_id, url, payload: bytes, sha1: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record, uncompressed."""
    target = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'-' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join([*fields, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload. Raises if the digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(field: str):
        value = fields[field].removeprefix(f"<{URN}").removesuffix(">")
        return None if value == "-" else int(value)

    refers_to = page("WARC-Refers-To") if revisit else None
    return page("WARC-Record-ID"), n, digest, fields["WARC-Type"], refers_to, fields["WARC-Target-URI"], payload


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on `samples`; empty if they are too few or too small to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Appends records to a stream. Without a dictionary, the first ones are held until there are enough to train one."""

    def __init__(self, out: BinaryIO, level: int = 3, trained: bytes = b""):
        self.out, self.level = out, level
        self.held: list[bytes] | None = []
        self.held_bytes = self.written = self.records = 0
        if trained:
            self._start(trained)

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.held is None:
            self._put(self.compressor.compress(raw))
            return
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self, trained: bytes = b"") -> None:
        trained = trained or dictionary([raw[:SAMPLE_BYTES // 8] for raw in self.held])
        if trained:
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=True)
        held, self.held = self.held, None
        for raw in held:
            self._put(self.compressor.compress(raw))

    def close(self) -> None:
        if self.held is not None:
            self._start()
        self.out.close()


def records(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive one after the other; no more than one and a chunk is held."""
    head = stream.read(8)
    trained, pending = b"", head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        trained, pending = stream.read(struct.unpack("<I", head[4:])[0]), b""
        if trained[:4] == ZSTD_MAGIC:  # the dictionary may be compressed itself
            trained = zstandard.ZstdDecompressor().decompressobj().decompress(trained)
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    frame, parts = None, []
    while pending or (pending := stream.read(chunk)):
        frame = frame or decompressor.decompressobj()
        parts.append(frame.decompress(pending))
        pending = b""
        if frame.eof:
            yield b"".join(parts)
            pending, frame, parts = frame.unused_data, None, []
    if frame is not None:
        raise ValueError("the archive ends within a record")


def _trained(rows: DataFrame, date: str) -> bytes:
    """A dictionary for all records: trained on the heads of about half of SLICES records, and on places anywhere."""
    total = rows.count()
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(share < min(1.0, SLICES / 2 / max(1, total)))
    # fewer records give more slices each
    each = F.least(F.ceil(F.col("size") / SLICE_BYTES), F.lit(max(1, SLICES // 2 // max(1, total)))).cast("int")
    room = F.greatest(F.col("size") - SLICE_BYTES, F.lit(0)) + 1
    at = F.transform(F.sequence(F.lit(1), F.greatest(each, F.lit(1))), lambda i: F.pmod(F.xxhash64("sha1", i), room).cast("int"))
    slices = F.transform(at, lambda a: F.substring("payload", a + 1, F.lit(SLICE_BYTES)))
    head = F.substring("payload", 1, SLICE_BYTES).alias("head")
    picked = picked.select("page_id", "url", "sha1", "size", head, slices.alias("slices")).dropDuplicates(["sha1"])
    samples = []
    for row in sorted(picked.collect(), key=lambda r: r["sha1"]):  # about SLICES slices
        samples.append(record(row["page_id"], row["url"], bytes(row["head"]), bytes.fromhex(row["sha1"]), None, False, date))
        if row["size"] > SLICE_BYTES:
            samples += [bytes(piece) for piece in row["slices"]]
    return dictionary(samples)


def _write(folder: str, date: str, trained: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _file_system(folder)
        context = TaskContext.get()
        writer, done = None, []

        def finish() -> None:
            writer.close()
            done.append((path, writer.records, writer.written))

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, sha1, refers_to, revisit = (x.as_py() for x in row)
                if writer is None:
                    # a name of this attempt: only archives of attempts that end well are listed
                    path = f"{at}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):03d}.warc.zst"
                    writer = ArchiveWriter(files.open_output_stream(path), trained=trained)
                writer.add(record(page_id, url, payload, bytes.fromhex(sha1), refers_to, revisit, date))
                if writer.written >= ARCHIVE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            paths, n, sizes = zip(*done, strict=True)
            yield pa.record_batch([pa.array(paths), pa.array(n), pa.array(sizes)], names=["path", "records", "bytes"])

    return run


def write(
    spark: SparkSession, pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", id_column="page_id",
    url_column="url", html_column="html",
) -> DataFrame:
    """Writes archives to the shared `folder`; returns their list (path, records, bytes).

    Payloads are equal when their SHA-1 and size are. Of equal ones of at least 1000 bytes the record with the largest
    id is the response; rows that repeat that id are responses too. Null pages have an empty payload, null addresses
    become about:blank, and a null id is written as such and smaller than any other. Each row is a record. An empty
    table gives no archive.
    """
    common.ready_workers(spark)
    files, at = _file_system(folder)
    payload = F.coalesce(F.col(html_column).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    same = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("sha1", "size")
    originals = same.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    originals = common.staged(spark, originals, "originals")  # of known size; a frequent payload's rows can be split
    marked = rows.join(originals, ["sha1", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    marked = marked.select("page_id", "url", "payload", "sha1", "original", revisit.alias("revisit"))
    files.create_dir(at, recursive=True)
    return common.staged(spark, marked.mapInArrow(_write(folder, date, _trained(rows, date)), MANIFEST), "archives")


def _uri(folder: str) -> str:
    """The folder as the archives' file library names it; Hadoop's names of one object store are one name there."""
    scheme, colon, rest = folder.partition("://")
    if colon and scheme in ("s3a", "s3n"):
        return f"s3://{rest}"
    return folder if colon or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    try:
        return pafs.FileSystem.from_uri(_uri(folder))
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives cannot be written to or read from {folder}: {error}") from error


def read(spark: SparkSession, folder: str, archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the listed archives, an archive per task; with `payload`, that of responses too."""
    common.ready_workers(spark)
    schema = RECORDS + (", payload binary" if payload else "")
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path) as stream:
                    rows, size = [], 0
                    for raw in records(stream):
                        rows.append(parsed(raw)[: len(names)])
                        size += len(raw) if payload else 256
                        if size >= 8 << 20:
                            yield _rows(rows, names, kinds)
                            rows, size = [], 0
                    yield _rows(rows, names, kinds)

    listed = archives.select("path")
    return listed.repartition(max(1, listed.count())).mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
