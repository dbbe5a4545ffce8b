import hashlib
import random
import zlib
from array import array

import public_tokenizers
import tokenizers

from roomledger.llm import bpe, tokens

BYTES, WORDS = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))
SPACES = [chr(i) for i in range(0x3100) if chr(i).isspace()] + [" "] * 8 + ["​", "\x1c", "﻿"]
LETTERS = [*"abcXYZ19!'?.,$<|>", "é", "́", "२", "日本", "😀", "Σ", "İ", "ǆ", "ﬁ", "ͅ", "'re", "<|endoftext|>"]


def texts(n=3000):
    rng = random.Random(5)
    mixed = ["".join(rng.choice(SPACES if rng.random() < 0.4 else LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*mixed, "", "a" * 3000, "ab" * 2000, " " * 700, "é" * 900, "The thing, the THING. The end!! x" * 3]


def library(path):
    return tokenizers.Tokenizer.from_file(path)


def ids(path, given):
    return [array("I", e.ids).tobytes() for e in library(path).encode_batch(given, add_special_tokens=False)]


def test_rank_array_gives_the_ids_of_the_library():
    given, coder = texts(), bpe.Coder(BYTES)
    assert [coder.encode(t) for t in given] == ids(BYTES, given)
    assert [coder.decode(coder.encode(t)) for t in given] == given


def test_long_words_merge_in_the_same_order():
    coder = bpe.Coder(BYTES)
    word = b"thethingsandother" * 14
    assert coder.word(word) == coder._long([coder.first[b] for b in word])


def test_bytes_that_are_no_text_decode_as_in_the_library():
    coder = bpe.Coder(BYTES)
    alone = [coder.first[b] for b in "é日".encode()][:-1]
    assert coder.decode(array("I", alone).tobytes()) == library(BYTES).decode(alone, skip_special_tokens=False)


def test_chunks_give_the_ids_of_whole_texts():
    given = texts()
    assert tokens.ChunkEncoder(BYTES).encode(given) == ids(BYTES, given)
    assert tokens.ChunkEncoder(WORDS).encode(given) == ids(WORDS, given)


def test_safe_chunks_give_the_ids_of_the_library_for_every_letter():
    """Latin letters, marks and spaces in all neighbourhoods, also those of the added tokens' spelling."""
    rng = random.Random(8)
    alphabet = [chr(i) for i in range(0x250)] + [*"aZ19!?._-'|<>" * 12, *"\t\n\r" * 4, "'s", "'LL", "<|ENDOFTEXT|>", "<|startoftext|>"]
    given = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(8000)]
    for path in (BYTES, WORDS):
        encoder = tokens.ChunkEncoder(path)
        assert encoder.kind and encoder.encode(given) == ids(path, given)
        assert encoder.pieces and any(map(encoder._safe, given)) and not all(map(encoder._safe, given))


def test_a_tokenizer_of_another_kind_goes_through_the_library(tmp_path):
    other = library(BYTES)
    other.normalizer = tokenizers.normalizers.Replace("a", "e")
    other.save(str(tmp_path / "other.json"))
    encoder = tokens.ChunkEncoder(str(tmp_path / "other.json"))
    given = texts(200)
    assert encoder.kind is None and encoder.encode(given) == ids(str(tmp_path / "other.json"), given)


def test_round_trip_of_odd_rows(spark, odd_docs):
    got = bpe.round_trip(spark, odd_docs, BYTES).collect()
    given = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for doc_id, text in given:
        want = ids(BYTES, [text])[0]
        row = (doc_id, len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert row in [tuple(r) for r in got]
    assert bpe.round_trip(spark, odd_docs.limit(0), BYTES).count() == 0


def test_encoded_ids(spark, make_docs):
    row = bpe.encoded(spark, make_docs(["two words"]), BYTES).first()
    assert row.ids == library(BYTES).encode("two words").ids
    assert zlib.crc32(array("I", row.ids).tobytes())


def test_cuts_in_arrow_are_those_of_chunks(monkeypatch):
    """Texts with and without odd spaces in one run, as caches overflow; chunks seen once are looked up once."""
    given = [*texts(800), "Plain words, plain WORDS", " led by a space", "two  spaces", "a　b c", "line \nend", "x\x0by z"]
    for path in (BYTES, WORDS):
        monkeypatch.setattr(tokens, "KEPT_WORDS", 60)
        encoder, asked = tokens.ChunkEncoder(path), []
        parts = [given[i : i + 50] for i in range(0, len(given), 50)]
        assert [got for part in parts for got in encoder.encode(part)] == ids(path, given)
        monkeypatch.undo()
        encoder = tokens.ChunkEncoder(path)
        look = encoder._of_chunks
        encoder._of_chunks = lambda chunks: asked.append(list(chunks)) or look(chunks)
        encoder.encode(["one two two three two", "four two three"])
        wanted = {*"one two three four".split()} if encoder.lower else {"two", "three"}
        assert [sorted(chunks) for chunks in asked] == [sorted(wanted)]


def test_words_of_safe_texts_are_those_of_the_pattern():
    """Apostrophes, digits, signs, long letters and empty texts side by side; no word reaches into the next text."""
    rng = random.Random(11)
    alphabet = [*"'abdelmrstvD19_!-.", "'s", "'LL", "'re", "'Ve", " ", " ", "\n", "\t", "É", "ß", "Ⱥ", "ſ"]
    given = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(20000)]
    given += ["it's", "'", "''s", "'", "s", "'l", "l", "90's", "'S", ""]
    encoder = tokens.ChunkEncoder(WORDS)
    given = [text for text in given if encoder._safe(text)]
    got, counts = tokens.words(given)
    want = [encoder.words.findall(text.lower()) for text in given]
    assert got.to_pylist() == [word for found in want for word in found]
    assert counts.tolist() == [len(found) for found in want]
    assert [w.to_pylist() for w in tokens.words([])[:1]] == [[]] and tokens.words([""])[1].tolist() == [0]
    assert encoder.encode(given) == ids(WORDS, given)


def test_spellings_of_a_word_are_looked_at_once():
    """Case, line ends and signs beside a word make no other one, also between texts that are not safe."""
    given = ["The the, THE. (the)\nthe's the", "a curly \u201cthe\u201d here", "", "The end"]
    encoder, asked = tokens.ChunkEncoder(WORDS), []
    look = encoder._of_chunks
    encoder._of_chunks = lambda chunks: asked.append(list(chunks)) or look(chunks)
    assert encoder.encode(given) == ids(WORDS, given)
    assert [sorted(found) for found in asked] == [sorted(["the", ",", ".", "(", ")", "'s", "end", *given[1].split()])]


def test_words_with_spaces_are_those_of_the_pattern():
    """White space of all lengths, signs and endings side by side; no word reaches into the next text."""
    rng = random.Random(12)
    alphabet = [*"'abdelmrstvD19_!-.", "'s", "'LL", "'re", "'ll", " ", " ", " ", "  ", "\n", "\t", "\r", "É", "ß", "ſ"]
    given = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(20000)]
    given += ["", " ", "  ", "\n", " \n", "\n ", "'", " '", " 's", "'s", "s", "''s", "a 's", "a  's", "a\n's", "'l", "l"]
    encoder = tokens.ChunkEncoder(BYTES)
    given = [text for text in given if encoder._safe(text)]
    got, counts, bare = tokens.spaced_words(given)
    want = [encoder.words.findall(text) for text in given]
    found = [word if alone else f" {word}" for word, alone in zip(got.to_pylist(), bare.tolist(), strict=True)]
    assert found == [word for words in want for word in words]
    assert counts.tolist() == [len(words) for words in want]
    assert [list(part) for part in tokens.spaced_words([])] == [[], [], []] and tokens.spaced_words([""])[1].tolist() == [0]
    assert encoder.encode(given) == ids(BYTES, given)


def test_signs_beside_a_word_with_its_space_make_no_other_one():
    given = ["a the the, the. the)\nthe's (the", "a curly \u201cthe\u201d here", "", "a end"]
    encoder, asked = tokens.ChunkEncoder(BYTES), []
    look = encoder._of_chunks
    encoder._of_chunks = lambda chunks: asked.append(list(chunks)) or look(chunks)
    assert encoder.encode(given) == ids(BYTES, given)
    assert [sorted(found) for found in asked] == [sorted(["the", "(", "end", *given[1].split()[1:]])]
