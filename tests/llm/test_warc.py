import hashlib
import io
import random
import struct

import pyarrow.fs as pafs
import pytest
import zstandard

from roomledger.llm import common, warc


class Kept(io.BytesIO):
    def close(self):
        pass


def archive(n=400):
    out = Kept()
    writer = warc.ArchiveWriter(out)
    raws = []
    for i in range(n):
        payload = (f"<html><body><p>page {i} of the site, with the usual text around</p></body></html>" * 8).encode()
        raws.append(warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).digest(), None, False, "1970-01-01T00:00:00Z"))
        writer.add(raws[-1])
    writer.close()
    return out.getvalue(), raws


def test_dictionary_leads_in_a_skippable_frame_and_each_record_is_a_frame():
    data, raws = archive()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert known.dict_id()
    rest, got = data[8 + size :], []
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        got.append(frame.decompress(rest))
        rest = frame.unused_data
    assert got == raws
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in raws)
    assert len(data) - 8 - size < alone / 2


@pytest.mark.parametrize("chunk", (7, 1000, 1 << 20))
def test_records_are_read_back_in_any_chunks(chunk):
    data, raws = archive(60)
    assert list(warc.records(io.BytesIO(data), chunk)) == raws


def test_damage_is_noticed():
    data, _ = archive(5)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-3])))


def test_pages(spark):
    big, small = "é" * 600, "small"
    pages = [(1, "http://a", big), (2, None, big), (3, "http://c d\n", big), (4, "u", small), (5, "u", small),
             (6, "u", None), (7, "u", ""), (3, "http://c d\n", big), (None, "u", big), (8, "u", "x" * 300_000)]
    frame = spark.createDataFrame([(*p, 1, "s") for p in pages], "page_id bigint, url string, html string, size int, sha1 string")
    folder = common.scratch(spark, "warc-test")
    archives = warc.write(spark, frame, folder)
    got = sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in
         warc.read(spark, folder, archives, payload=True).collect()), key=str,
    )
    want = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        revisit = html == big and page_id != 3
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                     3 if revisit else None, b"" if revisit else data))
    assert got == sorted(want, key=str)


def test_archives_of_a_few_long_records_have_a_dictionary(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)]
    pages = [(i, f"http://x/{i}", " ".join(rng.choices(words, k=60_000))) for i in range(4)]
    folder = common.scratch(spark, "warc-test")
    archives = warc.write(spark, spark.createDataFrame(pages, "page_id bigint, url string, html string"), folder)
    for row in archives.collect():
        with pafs.LocalFileSystem().open_input_stream(row.path) as stream:
            assert struct.unpack("<I", stream.read(4))[0] == warc.DICTIONARY_FRAME
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, folder, archives, payload=True).collect()}
    assert got == {i: html for i, _, html in pages}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = common.scratch(spark, "warc-test")
    assert warc.read(spark, folder, warc.write(spark, frame, folder)).count() == 0


def test_object_stores_have_one_name_and_others_fail_at_once(spark, make_docs):
    assert warc._uri("s3a://bucket/archives") == warc._uri("s3n://bucket/archives") == "s3://bucket/archives"
    assert warc._uri("file:/tmp/x") == "file:///tmp/x" and warc._uri("/tmp/x") == "/tmp/x"
    with pytest.raises(ValueError, match="nosuch://x"):
        warc.write(spark, make_docs(["a"]).withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"}), "nosuch://x")
