"""Byte-pair encoding and decoding with a contiguous rank array.

A short word is held as its parts in a row and the rank of each adjacent pair. The smallest rank is looked for again
and again, the boundary there is deleted, and the two neighbouring ranks are refreshed. On the few bytes of a word a
scan of one small array beats any queue; only words of over `SHORT` bytes use a heap, with the same order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common, tokens

CODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 256
NONE = 1 << 30

_open: dict[str, Coder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *self.specials.values()]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocabulary[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocabulary[left] << 20 | vocabulary[right], len(self.merged))
            self.merged.append(vocabulary[left + right])
        self.words = regex.compile(WORDS)
        ordered = sorted(map(regex.escape, self.specials), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(ordered)})") if ordered else None
        self.known = _Known(self)

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.first[b] for b in word]
        if len(parts) > SHORT:
            return self._long(parts)
        rank_of, merged = self.rank.get, self.merged
        ranks = [rank_of(a << 20 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 20 | parts[i + 1], NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same merges, the leftmost of the smallest rank first, for words of any length."""
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank_of = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 20 | parts[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or rank_of(parts[i] << 20 | parts[j]) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    r = rank_of(parts[a] << 20 | parts[after[a]], NONE)
                    if r < NONE:
                        heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def chunk(self, text: str) -> bytes:
        ids: list[int] = []
        for section in self.special.split(text) if self.special else [text]:
            if section in self.specials:
                ids.append(self.specials[section])
            else:
                for word in self.words.findall(section):
                    ids += self.word(word.encode())
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > tokens.KEPT_WORDS:
            self.known = _Known(self)
        first, *rest = tokens.chunks(text)
        return self.chunk(first) + b"".join(map(self.known.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class _Known(dict):
    """Ids by chunk, the space before it left out of the key."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.coder.chunk(" " + chunk)
        if len(chunk) <= tokens.KEPT_CHARS:
            self[chunk] = ids
        return ids


def coder(path: str) -> Coder:
    """One coder per worker process and file."""
    if path not in _open:
        _open[path] = Coder(path)
    return _open[path]


def encoded(spark: SparkSession, docs: DataFrame, path: str, id_column="doc_id", text_column="text") -> DataFrame:
    """(id, ids): token ids of every whole text. Null texts count as empty and have no ids; rows are kept as they are."""
    common.ready_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            ids = [np.frombuffer(code.encode(x.as_py() or ""), "<u4").astype("<i4") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row: the number of ids, and digests of the ids and of the text decoded from them.

    Null texts count as empty. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    common.ready_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = code.encode(text.as_py() or "")
                decoded = code.decode(ids).encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, coded, back = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string")).mapInArrow(run, CODED)
