"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a run of one character class's characters. A window slides over it; the counts of its characters, and
with them the sum of n log2 n, change by the character that leaves and the one that enters, so a step costs the same
for any window. Windows over the class's threshold join into spans. A candidate that an allow-list names, or that is
a path of words or a run of the alphabet, gives none. Dates, UUIDs and parts with the word example are cut out of a
candidate, and what is left of it is searched.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common

FOUND = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"
)
#: The patterns, and the fewest characters of a match (of its second group, if it has one).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 12), ("access", ACCESS, 18), ("hex", HEX, 16))


@dataclass(frozen=True)
class CharacterClass:
    """Runs of `characters`, and the bits per character from which a window of `window` characters is a secret.

    A window also needs a digit and a letter: words of any length and plain numbers are not secrets.
    """

    kind: str
    characters: str
    window: int
    bits: float

    def candidates(self) -> re.Pattern:
        return re.compile(f"[{self.characters}]{{{self.window},}}")


CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 20, 2.9),
    CharacterClass("entropy_alnum", "0-9A-Za-z", 20, 3.7),
    CharacterClass("entropy_base64", "0-9A-Za-z+/_=-", 24, 3.9),
)
#: Candidates that are known to be harmless as a whole.
ALLOWED = (
    re.compile(r"([A-Za-z]+|\d+)([-_/=+]+([A-Za-z]+|\d+))+"),  # words and numbers in a row, as in paths
    re.compile(r"(.{1,8}?)\1{2,}.{0,7}"),  # the same few characters again and again
)
#: Parts of candidates that are harmless; what is before and after them is not.
ALLOWED_PARTS = (
    re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"),  # UUID
    re.compile(r"(?<![0-9A-Za-z])\d{4}([-/])\d\d\1\d\d(T\d\d([-_]?\d\d){0,2}Z?)?(?![0-9A-Za-z])"),  # date
    re.compile(r"(?i:(?<![^-_/+=])[^-_/+=]*?example[^-_/+=]*)"),  # between two separators, or all of it
)
ALPHABETS = ("0123456789abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "fedcba9876543210")


def allowed(candidate: str, patterns=ALLOWED, literals: frozenset[str] = frozenset()) -> bool:
    low = candidate.lower()
    if candidate in literals or any(low in alphabet * 2 for alphabet in ALPHABETS):
        return True
    return any(p.fullmatch(candidate) for p in patterns)


def suspicious(candidate: str, parts=ALLOWED_PARTS) -> list[tuple[int, int]]:
    """What is left of a candidate without its harmless parts, as (start, end)."""
    out, at = [], 0
    for start, end in [*_union(m.span() for p in parts for m in p.finditer(candidate)), (len(candidate),) * 2]:
        if at < start:
            out.append((at, start))
        at = end
    return out


class _Cover:
    """Tells whether one of some spans covers a given one."""

    def __init__(self, places):
        places = sorted(places)
        self.starts = [start for start, _ in places]
        self.reach = list(itertools.accumulate((end for _, end in places), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect.bisect_right(self.starts, start)
        return before > 0 and self.reach[before - 1] >= end


def hot_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Places in `run` covered by windows of at least `bits` per character that hold a digit and a letter."""
    if len(run) < window:
        return []
    cost = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9  # H = log2 w - sum(n log2 n) / w
    counts = Counter(run[:window])
    total = sum(cost[n] for n in counts.values())
    digits = sum(c.isdigit() for c in run[:window])
    letters = sum(c.isalpha() for c in run[:window])
    out: list[tuple[int, int]] = []
    for start in range(len(run) - window + 1):
        if start:
            old, new = run[start - 1], run[start + window - 1]
            n = counts[old]
            total += cost[n - 1] - cost[n]
            counts[old] = n - 1
            n = counts[new]
            total += cost[n + 1] - cost[n]
            counts[new] = n + 1
            digits += new.isdigit() - old.isdigit()
            letters += new.isalpha() - old.isalpha()
        if total <= most and digits and letters:
            if out and out[-1][1] >= start:
                out[-1] = (out[-1][0], start + window)
            else:
                out.append((start, start + window))
    return out


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) by start, then kind as listed."""
    out = []
    for order, (kind, pattern, least) in enumerate(KINDS):
        group = pattern.groups
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind, m.start(group)))
    return [(start, end, kind, value) for start, _, end, kind, value in sorted(out)]


def entropy_spans(text: str, base, classes=CLASSES, literals=frozenset()) -> list[tuple[int, int, str, int]]:
    """Spans by entropy that no base span and no span of an earlier class covers."""
    taken = [(start, end) for start, end, _, _ in base]
    out = []
    for cls, pattern in ((c, _patterns(c)) for c in classes):
        covered = _Cover(taken)
        for m in pattern.finditer(text):
            run = m.group()
            if not any(map(str.isdigit, run)) or not any(map(str.isalpha, run)) or allowed(run, literals=literals):
                continue
            for first, last in suspicious(run):
                for a, b in hot_windows(run[first:last], cls.window, cls.bits):
                    a, b = a + first + m.start(), b + first + m.start()
                    if not covered(a, b):
                        out.append((a, b, cls.kind, a))
        taken += [(a, b) for a, b, kind, _ in out if kind == cls.kind]
    return out


_compiled: dict[CharacterClass, re.Pattern] = {}


def _patterns(cls: CharacterClass) -> re.Pattern:
    if cls not in _compiled:
        _compiled[cls] = cls.candidates()
    return _compiled[cls]


def spans(text: str, classes=CLASSES, literals=frozenset()) -> tuple[list, list]:
    """Base spans, and all spans by start, then kind as listed."""
    base = base_spans(text)
    extra = entropy_spans(text, base, classes, literals)
    order = {kind: i for i, kind in enumerate([*(k for k, _, _ in KINDS), *(c.kind for c in classes)])}
    return base, sorted(base + extra, key=lambda s: (s[0], order[s[2]], s[1]))


def _listed(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in found)


def scan(
    spark: SparkSession, docs: DataFrame, id_column="doc_id", text_column="text", classes=CLASSES,
    literals: frozenset[str] = frozenset(),
) -> DataFrame:
    """Per row: counts of base matches, the digest of their list, and all spans.

    Places are counted in code points, ends exclusive. Null and empty texts have no spans: counts 0, and the digest of
    the empty string. Repeated rows and null ids are reported as they are, an empty table gives no rows, and
    other columns are not read. Texts are scanned whole, each in its own row.
    """
    common.ready_workers(spark)
    common.small_batches(spark)
    names = [field.split()[0] for field in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_held()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = spans(text.as_py() or "", classes, literals)
                n = Counter(kind for _, _, kind, _ in base)
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], digest, _listed(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], names=names)

    return docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string")).mapInArrow(run, FOUND)


def masked(text: str, mask: str = "[secret]", classes=CLASSES, literals=frozenset()) -> str:
    """`text` with the values of all spans replaced; overlapping spans become one mask."""
    _, every = spans(text, classes, literals)
    out, at = [], 0
    for start, end in _union((value, end) for _, end, _, value in every):
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def _union(places) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, end in sorted(places):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def redacted(
    spark: SparkSession, docs: DataFrame, text_column="text", length_column: str | None = None, mask: str = "[secret]",
) -> DataFrame:
    """All rows and columns of `docs`, secrets in the text replaced by `mask`.

    Texts without secrets, nulls among them, are left as they are; `length_column`, if given, follows changed texts.
    """
    common.ready_workers(spark)
    common.small_batches(spark)
    at = docs.columns.index(text_column)
    counted = None if length_column is None else docs.columns.index(length_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_held()
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            new = [text if text is None else masked(text, mask) for text in texts]
            columns[at] = pa.array(new, columns[at].type)
            if counted is not None:
                old = columns[counted].to_pylist()
                sizes = [n if a == b else len(b) for a, b, n in zip(texts, new, old, strict=True)]
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
