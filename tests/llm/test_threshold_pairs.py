"""Pairs planted just at the threshold of the embeddings' near-dedup, where bands miss most."""

import numpy as np

from convolake.llm import embeddings


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    n, dim = 1500, 64
    a, other = embeddings.unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    other = embeddings.unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.9002, 0.905, (n, 1))
    b = cos * a + np.sqrt(1 - cos**2) * other
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b, embeddings.unit(rng.normal(size=(4000, dim)))]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embeddings.near_dedup(frame).collect()}
    found = np.mean([got[n + i] == got[i] for i in range(n)])
    print(f"planted pairs found: {found:.4f}")
    assert found >= 0.985
    assert all(got[i] == i for i in range(2 * n, len(rows)))


def test_bands_stop_growing():
    assert embeddings.bands(10**10, 0.9) == embeddings.bands(10**6, 0.9)
    assert embeddings.bands(10**10, 0.9)[1] < 60
