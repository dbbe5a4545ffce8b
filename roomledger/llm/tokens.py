"""Token ids of whole texts by a tokenizer file, with the ids of repeated words kept between texts.

Texts are cut at plain spaces. A chunk that was not seen before is cut into the tokenizer's words, where its file says
how and the chunk has no characters on which two engines could disagree; words not seen before go to the library's
model. All other chunks go through the whole library, and all texts do with a file of another kind. A text without such
characters is cut into words at once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

from roomledger.llm import common

#: White space that is rare in texts.
_RARE_SPACE = re.compile("[\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_RARE = ("\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD_SPACES = ("  ", " \n", "\n ", " \t", "\t ")
#: Chunks and words of more characters are encoded each time; so many shorter ones are kept per worker, chunks in an
#: older and a newer half: a full newer half becomes the older one, from which used chunks come back.
KEPT_CHARS, KEPT_WORDS = 48, 400_000
#: Characters whose case and class are the same in all engines: printable ASCII, line ends, and Latin letters but one.
_SAFE = re.compile("[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*")
#: The two ways to cut texts into words, as tokenizer files state them.
_CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
KINDS = {
    "spaces are part of words": (
        None,
        _BYTE_LEVEL | {"use_regex": True},
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+",
    ),
    "lower case, spaces dropped": (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        ]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _CLIP}, "behavior": "Removed", "invert": True},
            _BYTE_LEVEL | {"use_regex": False},
        ]},
        r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+",
    ),
}

def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))
#: What each byte of a safe text is part of; bytes of longer characters are all of letters.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = bytes(
    _LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SPACE if chr(b) in "\t\n\r " else _SIGN
    for b in range(256)
)
#: The same where a zero byte ends a text.
_END = 4
_CLASS_OR_END = bytes([_END]) + _CLASS[1:]


def _even(text: str) -> bool:
    """Whether each of the text's plain spaces is a cut."""
    if text[:1] == " " or text[-1:] == " " or any(odd in text for odd in _ODD_SPACES):
        return False
    return text.isascii() and not any(rare in text for rare in _ASCII_RARE) or not _RARE_SPACE.search(text)


def chunks(text: str) -> list[str]:
    """`text` cut at its plain spaces, which are left out.

    Only a space between two characters that are not white space is a cut. No token of the tokenizers used
    here reaches over such a place, so ids of the chunks in a row are the ids of the text. Where spaces are part of
    words, every chunk but the first is encoded with its space in front.
    """
    parts = text.split(" ")
    if not _even(text):
        whole = [parts[0]]
        for part in parts[1:]:
            before = whole[-1]
            if not before or not part or before[-1].isspace() or part[0].isspace():
                whole[-1] = f"{before} {part}"
            else:
                whole.append(part)
        parts = whole
    return parts


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of safe texts in lower case, without spaces: those of all texts in a row, and how many each text has.

    A word is a run of letters, one digit, a run of other signs, or an ending such as 's where no run of signs comes
    before its apostrophe.
    """
    parts = [text.lower().encode() for text in texts]
    joined = b"\n".join(parts)
    raw, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_CLASS), np.uint8)
    solid = kind != _SPACE
    starts = solid.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    if b"'" in joined:
        _part_endings(joined, np.flatnonzero(starts & (raw == ord("'"))), starts, solid)
    return _between(parts, raw, starts, solid)


def spaced_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of safe texts where spaces are part of words: those of all texts in a row, how many each text has, and
    which of them have no space in front. That space is left out.

    A word is a run of letters, digits or other signs, with a space before it, or an ending such as 's where no space
    and no sign comes before its apostrophe. White space is a word up to its last character, or to a text's end; that
    character is one if it is no space.
    """
    parts = [text.encode() for text in texts]
    joined = b"\0".join(parts)  # in no safe text
    raw, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_CLASS_OR_END), np.uint8)
    solid = kind != _END
    starts = solid.copy()
    starts[1:] &= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    starts[last] = True
    led = last[raw[last] == ord(" ")]
    starts[led] = solid[led] = False
    bare = np.ones(len(raw), dtype=bool)
    bare[led + 1] = False
    if b"'" in joined:
        _part_endings(joined, np.flatnonzero(starts & bare & (raw == ord("'"))), starts, solid)
    return *_between(parts, raw, starts, solid), bare[starts]


def _part_endings(joined: bytes, quotes: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> None:
    """Makes words of endings such as 's; `quotes` are the places of apostrophes that words start with."""
    one, two = (np.frombuffer(joined + b"\0\0", np.uint8)[quotes + i] for i in (1, 2))
    short = np.isin(one, list(b"stmd"))
    long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    starts[quotes[short | long] + 1] = False
    after = np.r_[quotes[short] + 2, quotes[long] + 3]
    after = after[after < len(starts)]
    starts[after] = solid[after]


def _between(parts: list[bytes], raw: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words from their starts, of what is solid, and how many each part has; a byte lies between the parts."""
    ends = np.cumsum([len(part) + 1 for part in parts])
    counts = np.diff(np.searchsorted(np.flatnonzero(starts), ends), prepend=0)
    letters, offsets = raw[solid], np.flatnonzero(starts[solid])
    buffers = pa.py_buffer(np.r_[offsets, len(letters)]), pa.py_buffer(letters)
    return pa.LargeStringArray.from_buffers(len(offsets), *buffers), counts


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers, equal to those of the library for the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = None
        for kind, (normalizer, pre_tokenizer, words) in KINDS.items():
            plain = spec["model"].get("type") == "BPE" and spec["post_processor"] is None
            if plain and spec["normalizer"] == normalizer and spec["pre_tokenizer"] == pre_tokenizer:
                self.kind, self.words = kind, re.compile(words)
        self.lower = self.kind == "lower case, spaces dropped"
        self.space = "" if self.lower else " "
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.mark = re.compile("|".join(map(re.escape, self.marks)) or r"(?!)", re.I if self.lower else 0)
        self.known: dict[str, bytes] = {}  # by chunk, without its space
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # by word of the tokenizer

    def _library(self, parts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(parts, add_special_tokens=False)
        return [array("I", got.ids).tobytes() for got in found]

    def _safe(self, chunk: str) -> bool:
        plain = chunk.isascii() and chunk.isprintable() or _SAFE.fullmatch(chunk)
        return bool(plain) and not ("<" in chunk and self.mark.search(chunk))

    def _ids(self, word: str) -> bytes:
        """Ids of one of the tokenizer's words, by the library's model."""
        if word.isascii() and word.isprintable():  # all its letters but the space stand for themselves
            letters = word.replace(" ", _LETTERS[0x20])
        else:
            letters = word.encode().decode("latin-1").translate(_LETTERS)
        ids = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
        if len(word) <= KEPT_CHARS:
            self.pieces[word] = ids
        return ids

    def _new(self, parts: list[str], space: str) -> list[bytes]:
        """Ids of chunks with `space` in front of each."""
        out, odd = [], []
        safe, lower, known, cut, ids_of = self._safe, self.lower, self.pieces.get, self.words.findall, self._ids
        look, mark, bare = self.model.tokenize, space and _LETTERS[0x20], space != self.space
        for i, part in enumerate(parts):
            if part.isascii() and part.isalpha():  # one word; after a space it is kept as a chunk
                word = part.lower() if lower else part
                if bare:
                    out.append(known(word) or ids_of(word))
                else:
                    out.append(known(space + word) or array("I", [token.id for token in look(mark + word)]).tobytes())
                continue
            part = space + part
            if not safe(part):
                odd.append(i)
                out.append(b"")
                continue
            words = cut(part.lower() if lower else part)
            if len(words) == 1:
                out.append(known(words[0]) or ids_of(words[0]))
            else:
                out.append(b"".join([known(word) or ids_of(word) for word in words]))
        for i, ids in zip(odd, self._library([space + parts[i] for i in odd]) if odd else (), strict=True):
            out[i] = ids
        return out

    def _of_chunks(self, parts: list[str]) -> list[bytes]:
        """Ids of different chunks that follow a space."""
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.older = {}, self.known
        known = self.known
        ids = list(map(known.get, parts))
        missing = [i for i, got in enumerate(ids) if got is None]
        before, new = self.older.get, []
        for i in missing:
            got = ids[i] = before(parts[i])
            if got is None:
                new.append(i)
            else:
                known[parts[i]] = got
        for i, got in zip(new, self._new([parts[i] for i in new], self.space), strict=True):
            ids[i] = got
            if len(parts[i]) <= KEPT_CHARS:
                known[parts[i]] = got
        return ids

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. Its chunks are numbered in Arrow, so that only different ones are looked at one by one.

        The words of safe texts stand for chunks.
        """
        texts = list(texts)
        if self.kind is None or not texts:
            return self._library(texts)
        if len(self.pieces) > KEPT_WORDS // 2:
            self.pieces = {}
        safe = [i for i, text in enumerate(texts) if self._safe(text)]
        rest = sorted({*range(len(texts))}.difference(safe))
        even = [i for i in rest if _even(texts[i])]
        odd = sorted({*rest}.difference(even))
        kind = pa.string() if sum(map(len, texts)) < 1 << 28 else pa.large_string()
        cut, of_safe, *bare = (words if self.lower else spaced_words)([texts[i] for i in safe])
        split = pc.split_pattern(pa.array([texts[i] for i in even], kind), " ")
        uneven = [chunks(texts[i]) for i in odd]
        of_rest = np.r_[np.diff(split.offsets.to_numpy()), [len(parts) for parts in uneven]].astype(np.int64)
        rest_of_odd = pa.array([part for parts in uneven for part in parts], kind)
        every = pa.concat_arrays([cut.cast(kind), split.flatten(), rest_of_odd])
        numbered = every.dictionary_encode()
        found, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        n, alone = len(found), []
        used = range(n)
        if self.space:  # by other numbers where no space is in front, as of a first chunk
            starts = len(cut) + np.cumsum(of_rest) - of_rest
            code = code.astype(np.int64)
            code[np.r_[np.flatnonzero(*bare), starts]] += n
            both = np.flatnonzero(np.bincount(code, minlength=2 * n))
            used, alone = both[both < n].tolist(), both[both >= n].tolist()
        ids = [b""] * (n + n * bool(alone))
        for i, got in zip(used, self._of_chunks([found[i] for i in used]), strict=True):
            ids[i] = got
        for i, got in zip(alone, self._new([found[i - n] for i in alone], ""), strict=True):
            ids[i] = got
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4  # of an id: 4 bytes
        first = np.cumsum(size) - size
        of_word = size[code]
        done = np.cumsum(of_word)
        at = np.repeat(first[code] - done + of_word, of_word)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        ends = 4 * np.r_[0, done][np.cumsum(np.r_[of_safe, of_rest])]
        out, a = [b""] * len(texts), 0
        for i, b in zip([*safe, *even, *odd], ends.tolist(), strict=True):
            out[i], a = raw[a:b], b
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, of the file asked for last."""
    return common.held(("tokens", path), lambda: ChunkEncoder(path))


def slices(column, most_chars: int = 4_000_000):
    """Runs of a string column, each of about `most_chars` characters; nulls count as empty."""
    run, size = [], 0
    for value in column:
        text = value.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= most_chars:
            yield run
            run, size = [], 0
    if run:
        yield run
