"""Words without a break: counts equal the library's, and cost about their length."""

import random
import time

import pytest

from convolake.llm import token_counts, vocab


@pytest.fixture(scope="module")
def merger():
    return token_counts.RankMerger(vocab.load(vocab.default_path()))


def words():
    rng = random.Random(7)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    out = [pick("abcdefghijklmnopqrstuvwxyz", n) for n in (257, 300, 1000, 5000, 40_000)]
    out += [pick("ab", 3000), "a" * 5001, "ab" * 2000, pick("éüöß", 2000), pick("中文字符", 1500), pick("thein", 4000), pick("-=_#*", 3000), "aaab" * 700, "short", "x"]
    return out


def test_equal_to_the_library(merger):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.default_path())
    texts = words()
    assert merger.count([t.encode() for t in texts]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [merger._by_rank(t.encode()) for t in texts if len(t) > 1] == merger._together([t.encode() for t in texts if len(t) > 1]).tolist()


def test_a_million_letters(merger):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    began = time.perf_counter()
    count = int(merger.count([text])[0])
    assert 300_000 < count < 700_000
    assert time.perf_counter() - began < 60


def test_bytes_that_no_merge_joins(merger):
    parts = merger._parts("abc中文abc".encode() * 50)
    assert b"".join(parts) == "abc中文abc".encode() * 50 and len(parts) > 50
