"""Repeats longer than 512 bytes among segments that differ at several places."""

import random

import numpy as np

from convolake.llm import suffix_dedup
from tests.llm.test_small_tables import brute_repeats


def test_repeats_over_512_bytes_are_not_parted():
    rng = random.Random(1)
    a = bytes(rng.randrange(97, 123) for _ in range(700))
    b, c = bytearray(a), bytearray(a)
    b[530] ^= 1
    c[650] ^= 1
    data = np.frombuffer(b"\xff".join((a, b, c)), dtype=np.uint8)
    many = 700 - suffix_dedup.SPAN + 1
    starts = np.concatenate([np.arange(k, k + many) for k in (0, 701, 1402)])
    place = np.tile(np.arange(many), 3)
    before = np.where(place > 0, data[np.maximum(starts - 1, 0)].astype(int), 256 + np.arange(3 * many))
    length = suffix_dedup.covered(*suffix_dedup.maximal_repeats(data, starts, 700 - place, before, suffix_dedup.SPAN))
    assert length[0] == 650 and length[many] == 530 and length[2 * many] == 650


def test_versions_of_a_passage(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        passage = "".join(rng.choice("abcdefgh ") for _ in range(1000))
        for at in rng.sample(range(420, 990), 5):
            texts.append(passage[:at] + "#" + passage[at + 1 :])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400)
