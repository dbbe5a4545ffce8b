"""Toxic documents by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A unit is a word as written, letters spelled out one by one, or two neighbouring fragments that are no words of the
language, as a blank in an insult leaves them. The kernel of two units counts the subsequences of
three letters or digits they share, with up to three characters of any kind skipped in each gap and a weight that falls
with every skipped character; it is normalised and sharpened by an exponential. So `i.d.i.o.t` and `idiiot` are
near `idiot`.

The machine is trained on sentences of labelled documents. A sentence starts with its document's label, and is as toxic
as its worst unit; sentences of toxic documents without any such unit lose the label, and training is repeated with
the worst unit of each sentence (multiple-instance learning). Insults with inserted characters are added as virtual
examples. A logistic model of the worst units turns margins into a document's score.

Training reads the whole texts of a bounded sample of labelled documents (`SAMPLE` of each label); the driver holds
them. Every document is scored on its whole text.

Of the units in the sample, all count as evidence; the machine is fitted on CANDIDATES for its landmarks, on all
witnesses, on OFTEN frequent, RARE random and HARD wrongly scored clean units, and on virtual examples of VARIED of each.
"""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import common

SAMPLE = 2000
LANDMARKS, DECAY, GAP, SHARP = 96, 0.7, 4, 6.0
UNIT, OVERLAP = 48, 16
SCORED = "doc_id bigint, held_out boolean, score double, predicted int, n_insults bigint"
CANDIDATES, OFTEN, RARE, HARD, VARIED = 600, 3000, 9000, 3000, 2000
#: Letters of a fragment at most, and clean documents of the sample from which on a unit is a word.
FRAGMENT, IN_USE = 8, 2
#: Units kept per worker, pairs of fragments, and half as many plain units.
KEPT = 300_000
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t\xa0]{1,4}\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGE = ".,;:!?\"'()[]{}<>|#$%&*"
_LOW = -4.0
_GAPS = list(itertools.product(range(1, GAP + 1), repeat=2))
_WEIGHTS = np.array([DECAY ** (d1 + d2 - 2) for d1, d2 in _GAPS])
#: Codes that a table of them has room for; others are looked up by bisection.
TABLE = 1 << 20
#: Codes of a unit, over which all landmarks are looked at for each.
LONG = 129


def units(text: str) -> list[str]:
    """Words as written, and runs of at least three single characters."""
    found = text.split()
    if _SPELLED.search(text):
        found += [m.group() for m in _SPELLED.finditer(text)]
    return found


def plain(unit: str) -> list[str]:
    """A unit in lower case without punctuation at its ends; long ones in overlapping pieces."""
    unit = unit.lower().strip(_EDGE)
    if len(unit) <= UNIT:
        return [unit]
    return [unit[a : a + UNIT] for a in range(0, len(unit) - OVERLAP, UNIT - OVERLAP)]


def _counted(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, weight) of all gap-limited subsequences of three characters, one row per word and code; and the
    letters, in whose numbers, as digits, codes are written."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    used = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    used[flat] = True
    seen = np.flatnonzero(used)
    seen = seen[np.array([chr(c).isalnum() for c in seen], dtype=bool)] if len(flat) else seen[:0]
    number = np.full(len(used), -1, dtype=np.int64)
    number[seen] = np.arange(len(seen))
    which, place = number[flat], len(seen)
    letter = which >= 0
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # of the word, with this character
    lead = (np.repeat(np.arange(len(words)), lengths) * place + which) * place
    keys = []  # a code's place among its word's equal ones follows from its gaps, as its weight does
    for i, (d1, d2) in enumerate(_GAPS):
        n = max(0, len(flat) - d1 - d2)
        at = np.flatnonzero((rest[:n] > d1 + d2) & letter[:n] & letter[d1 : d1 + n] & letter[d1 + d2 :])
        keys.append(((lead[at] + which[at + d1]) * place + which[at + d1 + d2]) * len(_GAPS) + i)
    key = np.concatenate(keys)
    key.sort()
    code, gaps = np.divmod(key, len(_GAPS))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
    weight = np.add.reduceat(_WEIGHTS[gaps], first) if len(first) else np.empty(0)
    owner, code = np.divmod(code[first], max(1, place) ** 3)
    return owner, code, weight, seen


def _written(code: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Codes of numbers of letters as codes of the letters; both are in one order."""
    rest, c3 = np.divmod(code, max(1, len(letters)))
    c1, c2 = np.divmod(rest, max(1, len(letters)))
    return letters[c1] << 42 | letters[c2] << 21 | letters[c3]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, weight) of all gap-limited subsequences of three characters, one row per word and code."""
    owner, code, weight, letters = _counted(words)
    return owner, _written(code, letters), weight


class Landmarks:
    """Kernel values of units against a fixed list of units."""

    def __init__(self, words: list[str]):
        self.words = words
        owner, code, weight = subsequences(words)
        self.codes, column = np.unique(code, return_inverse=True)
        norm = np.sqrt(np.bincount(owner, weight**2, len(words)))
        self.table = np.zeros((len(self.codes), len(words)), dtype=np.float32)
        self.table[column, owner] = weight / norm[owner]
        # the same by code: the landmarks that hold it, and its weight there
        order = np.argsort(column, kind="stable")
        self.holders, self.weights = owner[order], (weight / norm[owner])[order].astype(np.float32)
        self.n = np.bincount(column, minlength=len(self.codes))
        self.first = np.cumsum(self.n) - self.n

    def kernel(self, words: list[str]) -> np.ndarray:
        owner, code, weight, letters = _counted(words)
        norm = np.sqrt(np.maximum(np.bincount(owner, weight**2, len(words)), 1e-9))
        at = self._at(code, letters)
        known = np.flatnonzero(at >= 0)
        owner, at, weight = owner[known], at[known], weight[known]
        weight = weight.astype(np.float32)
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        length = np.bincount(owner, minlength=len(words))
        long = length > LONG
        if long.any():
            of_long = long[owner]
            first = np.flatnonzero(np.r_[True, np.diff(owner[of_long]) > 0])
            sums = np.add.reduceat(self.table[at[of_long]] * weight[of_long, None], first, axis=0)
            out[long] = sums / norm[long, None]
            place = np.arange(len(owner)) - (np.cumsum(length) - length)[owner]
            owner, at, weight, place = (x[~of_long] for x in (owner, at, weight, place))
        else:
            place = np.arange(len(owner)) - (np.cumsum(length) - length)[owner]
        out[~long] = (self._sums(owner, at, weight, place, length) / norm[:, None])[~long]
        return np.exp(SHARP * (out - 1))

    def _at(self, code: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where codes of these letters are among the landmarks' ones, or -1."""
        place = len(letters)
        if place and len(self.codes) and place**3 <= TABLE:
            three = np.stack([self.codes >> 42, self.codes >> 21 & 0x1FFFFF, self.codes & 0x1FFFFF])
            number = np.minimum(np.searchsorted(letters, three), place - 1)
            here = np.flatnonzero((letters[number] == three).all(axis=0))
            table = np.full(place**3, -1, dtype=np.int64)
            table[(number[0, here] * place + number[1, here]) * place + number[2, here]] = here
            return table[code]
        if not len(code) or not len(self.codes):
            return np.full(len(code), -1)
        written = _written(code, letters)
        at = np.minimum(np.searchsorted(self.codes, written), len(self.codes) - 1)
        return np.where(self.codes[at] == written, at, -1)

    def _sums(self, owner, at, weight, place, length) -> np.ndarray:
        """Products of known codes with all landmarks, summed by unit; `place` counts a unit's codes, at most LONG.

        Only landmarks that hold a code are looked at. Rounding is that of a sum over all codes in numpy's order: the
        first apart, of the rest eight running sums, and then those that make no eight.
        """
        n, size = self.n[at], len(length) * len(self.words)
        held = np.repeat(self.first[at] - np.cumsum(n) + n, n)
        held += np.arange(len(held))
        cell = np.repeat(owner * len(self.words), n) + self.holders[held]
        value = np.repeat(weight, n) * self.weights[held]
        rest = length[owner] - 1
        kind = np.where(place == 0, 9, np.where(place - 1 < rest - rest % 8, (place - 1) % 8, 8))
        kind = np.repeat(kind, n)
        lanes, one, tail = np.zeros((8, size), dtype=np.float32), kind == 9, kind == 8
        eight = kind < 8
        np.add.at(lanes.reshape(-1), kind[eight] * size + cell[eight], value[eight])
        sums = ((lanes[0] + lanes[1]) + (lanes[2] + lanes[3])) + ((lanes[4] + lanes[5]) + (lanes[6] + lanes[7]))
        np.add.at(sums, cell[tail], value[tail])
        sums[cell[one]] += value[one]
        return sums.reshape(len(length), len(self.words))


class _Numbers(dict):
    """Numbers of units, in the order in which they are asked for first."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


def _with(column: np.ndarray, n: int, values: list) -> np.ndarray:
    """The first `n` values of a column and these after them, with room for as many again."""
    if n + len(values) > len(column):
        column = np.concatenate([column[:n], np.zeros(n + 2 * len(values), dtype=column.dtype)])
    column[n : n + len(values)] = values
    return column


class Machine:
    """margin(unit) = sum of alpha * kernel(unit, landmark) + bias; score(document) by its worst units."""

    def __init__(self, landmarks: list[str], alpha: np.ndarray, bias: float, words: frozenset[str] = frozenset()):
        self.landmarks, self.alpha, self.bias = Landmarks(landmarks), alpha.astype(np.float32), bias
        self.words = words  # of the language
        insults = (w for w, a in zip(landmarks, alpha, strict=True) if a > 0)
        self.marks = {w[i : i + 3] for w in insults for i in range(len(w) - 2)}
        self.logistic = np.zeros(6)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()  # of units as written
        self.margin = np.empty(0)  # by number
        self.fragment = np.empty(0, dtype=bool)  # by number
        self.pairs: dict[int, int] = {}  # by the numbers of two fragments: that of both as one unit, or -1
        self.pieces: dict[str, float] = {}  # margins by plain unit

    def margins(self, words: Iterable[str]) -> dict[str, float]:
        """Margins of units as written."""
        words = list(words)
        return dict(zip(words, self._margins(words, [w.lower().strip(_EDGE) for w in words]), strict=True))

    def _margins(self, words: list[str], cut: list[str]) -> list[float]:
        """Margins of units; `cut` are the same in lower case without punctuation at their ends."""
        known = self.pieces
        long = {i: plain(words[i]) for i, p in enumerate(cut) if len(p) > UNIT}
        new = {p for p in cut if 2 < len(p) <= UNIT}.union(*long.values()).difference(known)
        flat = [p for p in new if len(p) > 2]
        for a in range(0, len(flat), 4000):
            part = flat[a : a + 4000]
            values = self.landmarks.kernel(part) @ self.alpha + self.bias
            known.update(zip(part, values.tolist(), strict=True))
        out = [known.get(p, _LOW) for p in cut]
        for i, parts in long.items():
            out[i] = max(known.get(p, _LOW) for p in parts)
        return out

    def _learnt(self, found: list[str]) -> np.ndarray:
        """Numbers of units; of new ones, what is asked about them later is found out."""
        n = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        new = list(itertools.islice(reversed(self.known), len(self.known) - n))[::-1]
        if new:
            cut = [w.lower().strip(_EDGE) for w in new]
            words = self.words
            self.margin = _with(self.margin, n, self._margins(new, cut))
            self.fragment = _with(self.fragment, n, [
                1 < len(p) <= FRAGMENT and len(w) <= FRAGMENT + 4 and p.isalpha() and p not in words
                for w, p in zip(new, cut, strict=True)
            ])
        return number

    def _joined(self, found: list[str], number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of neighbouring fragments that share letters in a row with an insult, so that they may be one: the
        texts that own them, and their numbers as units."""
        half = self.fragment[number]
        at = np.flatnonzero(half[:-1] & half[1:] & (owner[:-1] == owner[1:]))
        key, first, which = np.unique(number[at] << 32 | number[at + 1], return_index=True, return_inverse=True)
        key, units, known = key.tolist(), [], self.pairs
        for k, i in zip(key, at[first].tolist(), strict=True):
            if k not in known:
                whole = (found[i] + found[i + 1]).lower()
                marked = sum(whole[j : j + 3] in self.marks for j in range(len(whole) - 2)) > 1
                known[k] = -1
                if marked:
                    units.append((k, f"{found[i]} {found[i + 1]}"))
        if units:
            known.update(zip((k for k, _ in units), self._learnt([u for _, u in units]).tolist(), strict=True))
        pair = np.fromiter(map(known.__getitem__, key), np.int64, len(key))[which]
        return owner[at][pair >= 0], pair[pair >= 0]

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the units of each text, all of them learnt; they hold until the next call."""
        if len(self.known) > KEPT or len(self.pairs) > KEPT:
            pieces = self.pieces
            self.forget()
            self.pieces = pieces
        if len(self.pieces) > KEPT // 2:
            self.pieces = {}
        found = [units(text) for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        found = list(itertools.chain.from_iterable(found))
        number = self._learnt(found)
        if self.words:  # without any, no fragments are looked for
            owners, pairs = self._joined(found, number, owner)
            order = np.argsort(np.r_[owner, owners], kind="stable")
            owner, number = np.r_[owner, owners][order], np.r_[number, pairs][order]
        return np.split(number, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []

    def features(self, found: np.ndarray) -> np.ndarray:
        """Of a document whose units have been learnt: its three worst units, and how many are insults and different."""
        values = self.margin[found]
        worst = np.sort(values)[-3:][::-1]
        worst = np.clip(np.r_[worst, np.full(3 - len(worst), -1.0)], -1, 1)
        insults = found[values > 0]
        several = len(set(insults.tolist()))
        return np.r_[worst, np.log1p(several), np.log1p(100 * len(insults) / max(len(found), 20)), len(insults)]

    def score(self, features: np.ndarray) -> float:
        z = float(features[:5] @ self.logistic[:5] + self.logistic[5])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _newton(x: np.ndarray, step, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        gradient, hessian = step(w)
        move = np.linalg.solve(hessian, gradient)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss."""
    x = np.c_[x, np.ones(len(x))]
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]

    def step(w):
        slack = 1 - y * (x @ w)
        hit = slack > 0
        xh, wh = x[hit], weight[hit]
        return keep * w - xh.T @ (wh * y[hit] * slack[hit]), np.diag(keep) + (xh * wh[:, None]).T @ xh

    w = _newton(x, step)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    keep = np.r_[np.full(x.shape[1] - 1, 0.3), 1e-3]

    def step(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return keep * w + x.T @ (weight * (p - y)), np.diag(keep) + (x * (weight * p * (1 - p))[:, None]).T @ x

    return _newton(x, step)


def inserted(unit: str, rng: random.Random) -> list[str]:
    """Virtual examples: the unit with characters put in."""
    if len(unit) < 4:
        return []
    mark = rng.choice(".-*_ ")
    at = rng.randrange(1, len(unit) - 1)
    return [mark.join(unit), unit[:at] + mark + unit[at:], unit[:at] + unit[at] * 2 + unit[at:]]


def _different(candidates: list[str], most: int, apart: float = 0.5) -> list[str]:
    """The first candidates, without those whose kernel with an earlier one is over `apart`."""
    kernel = Landmarks(candidates).kernel(candidates) if candidates else np.empty((0, 0))
    chosen: list[int] = []
    for i in range(len(candidates)):
        if len(chosen) < most and (not chosen or kernel[i, chosen].max() < apart):
            chosen.append(i)
    return [candidates[i] for i in chosen]


def train(texts: list[str], toxic: list[int], prior: float | None = None, seed: int = 7) -> Machine | None:
    """Learns from labelled texts, of which a share `prior` is toxic where they come from; None if a label is missing."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return None
    rng = random.Random(seed)
    documents: list[list[list[str]]] = []  # sentences of toxic texts; of clean ones the counts are enough
    in_toxic, in_clean = Counter(), Counter()
    same: dict[str, str] = {}  # equal units are one object
    for text, label in zip(texts, toxic, strict=True):
        split = ([p for u in units(s) for p in plain(u) if len(p) > 2] for s in _SENTENCE.split(text))
        sentences = [[same.setdefault(u, u) for u in sentence] for sentence in split]
        (in_toxic if label else in_clean).update({u for s in sentences for u in s})
        if label:
            documents.append(sentences)
    n_toxic, n_clean = int(y.sum()), int((1 - y).sum())
    odds = {u: np.log((n + 0.5) / n_toxic) - np.log((in_clean[u] + 0.5) / n_clean) for u, n in in_toxic.items()}
    # evidence grows with both the odds and the number of documents; words of a topic or language are no insults
    strength = {u: odds[u] * np.sqrt(in_toxic[u]) for u in odds if odds[u] > 1.5}
    typical = _different(sorted(strength, key=lambda u: (-strength[u], u))[:CANDIDATES], LANDMARKS // 2)
    variants = [v for u in typical[: LANDMARKS // 8] for v in inserted(u, rng)[:1]]
    clean = sorted(in_clean, key=lambda u: (-in_clean[u], u))
    rare = rng.sample(clean, min(len(clean), LANDMARKS // 4))
    chosen = list(dict.fromkeys([*typical, *variants, *rare, *clean]))[:LANDMARKS]
    landmarks = Landmarks(chosen)
    kernel = landmarks.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])  # the Nystroem map: kernel(u, landmarks) @ root

    often, rest = clean[:OFTEN], clean[OFTEN:]
    negatives = [*often, *rng.sample(rest, min(len(rest), RARE))]
    worst_of = strength
    machine = None
    for _ in range(3):
        witnesses: Counter = Counter()
        for sentences in documents:
            for sentence in sentences:
                best = max((u for u in sentence if odds[u] > 1), key=lambda u: worst_of.get(u, _LOW), default=None)
                if best is not None and worst_of.get(best, _LOW) > (0 if machine else 4):
                    witnesses[best] += 1
        if not witnesses:
            return None
        positives = list(witnesses)
        virtual = [v for u in positives[:VARIED] for v in inserted(u, rng)]
        plain_virtual = [v for u in negatives[:VARIED] for v in inserted(u, rng)]
        words = [*positives, *virtual, *negatives, *plain_virtual]
        label = np.r_[np.ones(len(positives) + len(virtual)), -np.ones(len(negatives) + len(plain_virtual))]
        weight = np.ones(len(words))
        weight[: len(positives)] = np.minimum(10, [witnesses[u] for u in positives])
        weight[label < 0] = np.minimum(10, [in_clean.get(u, 1) for u in words[-int((label < 0).sum()) :]])
        weight[label > 0] *= weight[label < 0].sum() / weight[label > 0].sum() / 2
        x = np.concatenate([landmarks.kernel(words[a : a + 4000]) for a in range(0, len(words), 4000)]) @ root
        w, bias = svm(x, label, weight)
        machine = Machine(chosen, root @ w, bias, frozenset(u for u in clean if in_clean[u] >= IN_USE))
        worst_of = machine.margins({*in_toxic, *in_clean})
        hard = sorted(in_clean, key=lambda u: (-worst_of[u], u))[:HARD]
        negatives = list(dict.fromkeys([*hard, *often, *rng.sample(rest, min(len(rest), RARE))]))

    x = [machine.features(machine.units([text])[0])[:5] for text in texts]
    prior = n_toxic / len(y) if prior is None else prior
    balance = np.where(y == 1, prior * len(y) / n_toxic, (1 - prior) * len(y) / n_clean)
    machine.logistic = _logistic(np.array(x), y, balance)
    machine.forget()
    return machine


def remainder(id_column: str, of: int) -> Column:
    """crc32 of the id as text, modulo a number: which documents a model may learn from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % of


def sample(docs: DataFrame, labels: DataFrame, id_column, text_column, label) -> tuple[DataFrame, float]:
    """(id, text, label) of about SAMPLE labelled documents of each label that may be learnt from, chosen by a hash;
    and the share of toxic ones among all of them."""
    known = labels.where(F.col(label).isNotNull() & (remainder(id_column, 5) != 0))
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    totals = {row["_label"]: row["count"] for row in known.groupBy("_label").count().collect()}  # a row per label
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / float(1 << 20)
    pick = F.lit(False)
    for value, n in totals.items():
        pick |= (F.col("_label") == value) & (share < SAMPLE / n)
    chosen = known.where(pick)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_column).alias("_id"), text.alias("_text"))
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    return picked.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label"), prior  # about SAMPLE ids a label


def fit(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label="toxic") -> Machine | None:
    picked, prior = sample(docs, labels, id_column, text_column, label)
    rows = sorted(picked.collect(), key=lambda r: (r["_id"], r["_text"]))
    return train([r["_text"] for r in rows], [int(r["_label"] == 1) for r in rows], prior)


def scored(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label="toxic",
) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_insults (units with a positive margin).

    Null and empty texts are scored as texts without units. Without labels of both kinds nothing can be learnt, and
    every score is 0. Repeated rows get equal scores; rows with a null id are scored and not held out. An empty
    table gives no rows; other columns are not read.
    """
    common.ready_workers(spark)
    common.small_batches(spark)
    score = _scorer(spark, fit(docs, labels, id_column, text_column, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(1))
            arrays = [pa.array(c, k) for c, k in zip(found, (pa.float64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], names=["doc_id", "score", "predicted", "n_insults"])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string"))
    found = picked.mapInArrow(run, "doc_id bigint, score double, predicted int, n_insults bigint")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", "n_insults")


def _scorer(spark: SparkSession, machine: Machine | None):
    """A function for tasks: (scores, predictions, numbers of insults) of a column of texts."""
    model = spark.sparkContext.broadcast(machine)

    def score(column) -> tuple[list[float], list[int], list[int]]:
        common.drop_held()
        machine, rows = model.value, []
        texts = [text.as_py() or "" for text in column]
        if machine is None:
            return [0.0] * len(texts), [0] * len(texts), [0] * len(texts)
        for a in range(0, len(texts), 200):
            for f in machine.units(texts[a : a + 200]):
                features = machine.features(f)
                value = machine.score(features)
                rows.append((value, int(value >= 0.5), int(features[5])))
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])

    return score


def kept(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label="toxic",
) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns; each row is judged by its own text.

    Null and empty texts stay, as do all rows if nothing can be learnt. Rows with null or repeated ids are judged
    like others.
    """
    common.ready_workers(spark)
    common.small_batches(spark)
    score = _scorer(spark, fit(docs, labels, id_column, text_column, label))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not toxic for toxic in score(batch.column(at))[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
