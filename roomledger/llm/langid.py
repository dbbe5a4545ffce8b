"""Language of mixed texts: script ranges narrow the candidates, Viterbi labels spans.

A word is a run of letters. Its score in a language is the log probability of its character n-grams there, each word
set against the others, so scores of a word are the logarithms of shares. Only languages that write the word's script
are candidates. The best sequence of labels pays a penalty for every switch; runs of one label are spans, and the
document's language is the one with most letters.

Counts are learnt from the whole texts of a bounded sample of labelled documents, about `SAMPLE` of each language.
Every document is labelled on its whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common

SAMPLE = 800
LONGEST, FEWEST = 4, 2
#: Natural logarithms: the price of a switch, the worst score of a candidate and that of any other language.
SWITCH, FLOOR, NEVER = 6.0, -8.0, -16.0
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LABELLED = "doc_id bigint, lang_pred string, score double, n_spans int"
#: First code points of ranges, and the scripts that write letters there; other ranges up to the next are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA4D0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPTS]


def script(word: str) -> str:
    """The script of most letters of a word; the first of equal ones. Empty if there is no letter."""
    found = Counter(SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1] for c in word if c.isalpha())
    return found.most_common(1)[0][0] if found else ""


def spoken(word: str) -> bool:
    """Whether there is a letter; the pattern also finds other numerals than digits."""
    return word.isalpha() or any(map(str.isalpha, word))


def grams(word: str) -> list[str]:
    padded = f" {word.lower()} "
    return [padded[a : a + n] for n in range(1, LONGEST + 1) for a in range(len(padded) - n + 1)]


class Model:
    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: language to word to count."""
        self.languages = sorted(counts)
        k = len(self.languages)
        seen: dict[str, np.ndarray] = {}
        self.written: dict[str, np.ndarray] = {}
        for i, language in enumerate(self.languages):
            letters: Counter = Counter()
            for word, n in counts[language].items():
                letters[script(word)] += n * len(word)
                for gram in grams(word):
                    if gram not in seen:
                        seen[gram] = np.zeros(k)
                    seen[gram][i] += n
            for name, n in letters.items():
                if name and n >= 0.01 * letters.total():
                    self.written.setdefault(name, np.zeros(k, dtype=bool))[i] = True
        names = [g for g, n in seen.items() if n.sum() >= FEWEST]
        self.at = {g: i for i, g in enumerate(names)}
        table = np.array([seen[g] for g in names]) + 0.5 if names else np.zeros((0, k))
        if names:
            table = np.log(table / table.sum(axis=0))
            table -= table.mean(axis=1, keepdims=True)  # what all languages share says nothing
        self.table = np.r_[table, np.zeros((1, k))]
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, k))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > 1_000_000:
            self.known, self.scores = {}, self.scores[:0]
            new = list(words)
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.score(new)])

    def score(self, words: list[str]) -> np.ndarray:
        """Logarithms of shares, a row per word; words without a letter say nothing."""
        nothing = len(self.at)
        listed = [[self.at.get(g, nothing) for g in grams(w)] for w in words]
        lengths = np.array([len(row) for row in listed])
        flat = np.fromiter((i for row in listed for i in row), np.int64, int(lengths.sum()))
        sums = np.add.reduceat(self.table[flat], np.cumsum(np.r_[0, lengths[:-1]]), axis=0)
        sums /= np.sqrt(lengths)[:, None]  # n-grams of a word are not independent
        top = sums.max(axis=1, keepdims=True)
        out = np.maximum(sums - top - np.log(np.exp(sums - top).sum(axis=1, keepdims=True)), FLOOR)
        for i, word in enumerate(words):
            name = "latin" if word.isascii() else script(word)
            if not name:
                out[i] = 0
            elif name in self.written:
                out[i, ~self.written[name]] = NEVER
        return out


def viterbi(rows: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best label sequence for each matrix of word scores; matrices of like length go together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
    while order:
        longest = len(rows[order[0]])
        group, order = order[: max(1, 400_000 // longest)], order[max(1, 400_000 // longest) :]
        lengths = np.array([len(rows[i]) for i in group])
        k = rows[group[0]].shape[1]
        scores = np.zeros((longest, len(group), k))
        for d, i in enumerate(group):
            scores[: lengths[d], d] = rows[i]
        back = np.zeros((longest, len(group), k), dtype=np.int16)
        best, own = scores[0], np.arange(k)
        for t in range(1, longest):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # documents of more than t words
            top = best[:live].argmax(axis=1)
            moved = best[np.arange(live), top][:, None] - switch
            back[t, :live] = np.where(best[:live] >= moved, own, top[:, None])
            best = best.copy() if t == 1 else best
            best[:live] = np.maximum(best[:live], moved) + scores[t, :live]
        label = best.argmax(axis=1)
        paths = np.zeros((longest, len(group)), dtype=np.int64)
        each = np.arange(len(group))
        for t in range(longest - 1, -1, -1):
            paths[t] = label
            inside = t < lengths
            label = np.where(inside, back[t, each, label], label) if t else label
        for d, i in enumerate(group):
            out[i] = paths[: lengths[d], d]
    return out


def spans(text: str, labels: np.ndarray, languages: list[str]) -> list[tuple[int, int, str]]:
    """Runs of one label as (start, end, language) in code points; together they cover the text."""
    turns = np.flatnonzero(np.diff(labels)) + 1
    starts = [0]
    if len(turns):
        at = [m.start() for m in WORD.finditer(text) if spoken(m.group())]
        starts += [at[i] for i in turns]
    firsts = [0, *turns.tolist()]
    return [
        (start, end, languages[labels[i]])
        for start, end, i in zip(starts, [*starts[1:], len(text)], firsts, strict=True)
    ]


def remainder(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, id_column="doc_id", text_column="text", label="lang") -> Model:
    """Word counts of about SAMPLE documents per language, chosen by a hash of the id among those to learn from."""
    known = docs.where(F.col(label).isNotNull() & F.col(text_column).isNotNull() & (remainder(id_column) != 2))
    totals = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # a row per language
    share = F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 20)) / float(1 << 20)
    pick = F.lit(False)
    for language, n in totals.items():
        pick |= (F.col(label) == language) & (share < SAMPLE / n)
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text_column)), F.lit(r"(?U)(\p{L}+)"), F.lit(1))).alias("word")
    rows = known.where(pick).select(F.col(label).alias("lang"), word).groupBy("lang", "word").count()
    counts: dict[str, dict[str, int]] = {language: {} for language in totals}
    for row in rows.toArrow().to_pylist():  # at most the words of the sample
        counts[row["lang"]][row["word"]] = row["count"]
    return Model({language: words for language, words in counts.items() if words})


def labelled(
    spark: SparkSession, docs: DataFrame, id_column="doc_id", text_column="text", label="lang", with_spans: bool = False,
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, n_spans; with `with_spans`, spans (start, end, lang) too.

    lang_pred has most letters among the labels of the text's words, the first by name of equal ones; score is its share
    of the letters. Null texts and texts without a letter are `und` with score 0 and no span; so is all if no row
    has a label to learn from. Repeated rows get equal results; rows with a null id are labelled and not
    held out. An empty table gives no rows; other columns are not read.
    """
    common.ready_workers(spark)
    model = spark.sparkContext.broadcast(fit(docs, id_column, text_column, label))
    schema = LABELLED + (", spans array<struct<start: int, end: int, lang: string>>" if with_spans else "")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            rows = []
            texts = [text.as_py() or "" for text in batch.column(1)]
            for a in range(0, len(texts), 500):
                rows += _labelled(known, texts[a : a + 500], with_spans)
            language, score, n, found = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [batch.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int32())]
            names = ["doc_id", "lang_pred", "score", "n_spans"]
            if with_spans:
                dicts = [[{"start": s, "end": e, "lang": x} for s, e, x in spans_of] for spans_of in found]
                arrays, names = [*arrays, pa.array(dicts, pair)], [*names, "spans"]
            yield pa.record_batch(arrays, names=names)

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string"))
    found = picked.mapInArrow(run, schema)
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, *found.columns[1:])


def _labelled(model: Model, texts: list[str], with_spans: bool) -> list[tuple]:
    words = [[w for w in WORD.findall(text) if spoken(w)] if model.languages else [] for text in texts]
    model.learn({w for found in words for w in found})
    at = [np.fromiter(map(model.known.__getitem__, found), np.int64, len(found)) for found in words]
    out = []
    for text, found, labels in zip(texts, words, viterbi([model.scores[i] for i in at]), strict=True):
        if not found:
            out.append((UNKNOWN, 0.0, 0, []))
            continue
        letters = np.bincount(labels, [len(w) for w in found], len(model.languages))
        best = int(letters.argmax())
        runs = 1 + int(np.count_nonzero(np.diff(labels)))
        places = spans(text, labels, model.languages) if with_spans else []
        out.append((model.languages[best], float(letters[best] / letters.sum()), runs, places))
    return out
