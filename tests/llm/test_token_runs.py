"""The token store's encoder takes texts in runs: words are found in arrays, and the library gets many at a call."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from convolake.llm import token_store, vocab

LATIN = ["a", "re", "s", "l", "ll", "ve", "t", "m", "d", "'", "'", "'", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x00", "é", "Ā", "ɏ", "×", "÷", "1", "23", "_", "-", ".", "<", "|", "The", " the"]
OTHER = ["<|endoftext|>", "<|endo", "ɐ", "²", "ª", "中", "😀", "\x1c", "\x85", "\xa0", "　", "​"]


def texts_of(parts, n=3000, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randrange(16))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab.default_path())


def ids_of(raws):
    return [np.frombuffer(x, "<u4").tolist() for x in raws]


def test_words_of_latin_texts_begin_where_the_splitter_cuts():
    texts = texts_of(LATIN) + ["", "'", "'r", "'re", "x's", "x'l", "x 's", "x's's", "\n's", "' s", "a'", "é×é", "  ", "a  ", "  a", "\n a", "\n\na", "ɏ×"]
    split = vocab.splitter(vocab.load(vocab.default_path()).special)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    begin = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    assert not len(vocab.not_latin(data))
    starts = vocab.word_starts(data, begin)
    got = [data[s:e].tobytes().decode() for s, e in zip(starts, np.append(starts[1:], len(data)))]
    assert got == [w for t in texts for w in split(t)]


def test_other_texts_are_told_apart():
    for part in OTHER[2:]:
        assert len(vocab.not_latin(np.frombuffer(("a" + part).encode(), np.uint8))), part


@pytest.mark.parametrize("run_bytes, lines, remembered", [(8 << 20, 64, 500_000), (100, 3, 50), (1, 1, 0)])
def test_runs_give_the_ids_of_the_library(library, monkeypatch, run_bytes, lines, remembered):
    monkeypatch.setattr(token_store, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(token_store, "LINES", lines)
    monkeypatch.setattr(vocab, "REMEMBERED", remembered)
    texts = texts_of(LATIN, 300) + texts_of(LATIN + OTHER, 600, 3) + ["", "", "a" * 3000, " " * 500, "'s" * 200, ""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = token_store.LibraryEncoder(vocab.default_path())
    assert ids_of(encoder.encode(texts)) == want
    column = pa.array([*texts[:5], None, *texts[5:]], pa.string())
    assert ids_of(encoder.encode(column.slice(2))) == [*want[2:5], [], *want[5:]]
    assert ids_of(encoder.encode(column.slice(0, 0))) == []
    assert ids_of(encoder.encode([None, ""])) == [[], []]


def test_latin_texts_are_not_split_one_by_one_nor_words_sent_one_by_one(library):
    encoder = token_store.LibraryEncoder(vocab.default_path())
    sent = []

    class Counted:
        def encode_batch_fast(self, strings, **kw):
            sent.extend(strings)
            return library.encode_batch_fast(strings, **kw)

    def split(text):
        raise AssertionError("split one by one")

    encoder.library, encoder.split = Counted(), split
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgé", k=6)) for _ in range(200)) for _ in range(50)]
    assert ids_of(encoder.encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    words = len({w for t in texts for w in t.split(" ")})
    assert words > 5000 and len(sent) < words / 20
