"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np

from convolake.llm import simhash


def components_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}


def similarity(a, b):
    a, b = simhash._shingles(a, 5), simhash._shingles(b, 5)
    return len(a & b) / len(a | b)


def test_near_dedup_links_nothing_unread(spark):
    # 256-bit fingerprints of this pair differ in 22 bits, though it is less similar than 0.8
    rng = random.Random(1321)
    w = [f"w{rng.randrange(10**6)}" for _ in range(84)]
    texts = [" ".join(w), " ".join(w[:-9] + [f"v{rng.randrange(10**6)}" for _ in range(9)])]
    assert 0.79 < similarity(*texts) < 0.8
    assert components_of(spark, texts) == {0: 0, 1: 1}


def test_near_dedup_finds_every_pair(spark):
    # eight words and one more: 4 of 5 shingles; longer texts just at or above 0.8
    rng = random.Random(8)
    texts, want = [], {}
    for size, changed in [(8, 0)] * 60 + [(94, 10)] * 40 + [(184, 20)] * 20:
        w = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        other = w[: size - changed] + [f"v{rng.randrange(10**6)}" for _ in range(changed or 1)]
        assert 0.8 <= similarity(" ".join(w), " ".join(other)) < 0.802
        want |= {len(texts): len(texts), len(texts) + 1: len(texts)}
        texts += [" ".join(w), " ".join(other)]
    assert components_of(spark, texts) == want


def test_parity_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for size in (1, 5, 100, 3000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate((a[: size // 2], rng.integers(0, 1 << 63, size, dtype=np.uint64)))
        wide = [simhash._parity(x, 4096) for x in (a, b)]
        assert all((simhash._folded(w, 8) == simhash._parity(x, 512)).all() for w, x in zip(wide, (a, b)))
        assert int(np.bitwise_count(wide[0] ^ wide[1]).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))
        bits = int(np.bitwise_count(simhash._parity(a, 512) ^ simhash._parity(b, 512)).sum())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
