"""Nearest neighbours against brute force: exact where all meet, and by recall where buckets are probed."""

import math

import numpy as np
import pytest

from convolake.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string, node string, found string"
ASKED = "vec_id % 20 = 0"


def brute(rows, k=20):
    """rows: (id, vector) of valid rows of one dimension; the results of each asking row."""
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = []
    for i, (own, _) in enumerate(rows):
        if own is not None and own % 20 == 0:
            score = (x * x[i]).sum(axis=1)
            order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], rows[j][0]))[:k]
            out += [(own, n + 1, rows[j][0], score[j]) for n, j in enumerate(order)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def vectors(n, dim=16, seed=1, spread=0.5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dim))
    return (centre[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def test_all_meet(spark):
    x = vectors(300)
    rows = [(i, x[i].tolist()) for i in range(300)]
    rows += [(i, x[7].tolist()) for i in range(400, 460)]  # copies of one vector, more than are asked for
    rows += [(1000 + i, [float(a) for a in np.random.default_rng(i).integers(-1, 2, 16)]) for i in range(1, 60)]  # ties
    rows += [(20, x[20].tolist()), (40, x[41].tolist())]  # a repeated row, an id with two vectors
    bad = [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [1.0, None] * 8), (2080, [math.nan] * 16), (2100, [math.inf] * 16), (None, x[3].tolist())]
    valid = [r for r in rows if any(r[1])]
    got = found(neighbours.nearest(frame(spark, rows + bad), ASKED))
    want = sorted(brute(valid))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, n):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(n)]
    got = found(neighbours.nearest(frame(spark, rows), ASKED))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(brute(rows))]
    assert len(got) == n * (n - 1)


def test_dimensions_never_meet(spark):
    rows = [(20, [1.0, 2.0]), (21, [2.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 1.0, 1.0])]
    got = found(neighbours.nearest(frame(spark, rows), ASKED))
    assert [g[:3] for g in got] == [(20, 1, 21), (40, 1, 41)]


@pytest.mark.parametrize("spread,scale", [(0.3, False), (2.0, False), (0.5, True)])
def test_recall_in_buckets(spark, monkeypatch, spread, scale):
    monkeypatch.setattr(neighbours, "FEW", 100)
    monkeypatch.setattr(neighbours, "HELD", 2000)  # tasks merge and give way often
    monkeypatch.setattr(neighbours, "TILE", 300)  # buckets of several tiles
    x = vectors(3000, 24, 5, spread)
    if scale:  # lengths from a tenth to ten
        x *= 10 ** np.random.default_rng(6).uniform(-1, 1, (len(x), 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(neighbours.nearest(frame(spark, rows), ASKED)), brute(rows)
    assert len(got) == len(want) and len({g[:2] for g in got}) == len(got)
    true = {(q, i) for q, _, i, _ in want}
    assert len(true & {(q, i) for q, _, i, _ in got}) >= 0.93 * len(true)
    exact = x.astype(float)
    assert all(abs(s - (exact[q] * exact[i]).sum()) < 1e-9 for q, _, i, s in got)


def test_rare_buckets_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "choose", lambda *_: (12, 1, 1))
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    x = vectors(400, 16, 9, 3.0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(neighbours.nearest(frame(spark, rows), ASKED))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(brute(rows))]


def test_probes_are_in_order():
    x = neighbours.unit(vectors(50, 20, 3))
    for bits in (1, 4, 6, 9, 13):
        near = neighbours.probes(x, bits, 2, 64)
        assert (near[:, 0] == neighbours.buckets(x, bits, 2)).all()
        assert near.shape[1] == min(64, 2**bits) and all(len(set(r)) == len(r) for r in near.tolist())
    assert np.allclose(neighbours.hadamard(np.eye(8)) @ neighbours.hadamard(np.eye(8)).T, np.eye(8))
