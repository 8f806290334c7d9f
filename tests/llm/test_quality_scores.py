"""Scores of documents against a plain version: features by loops, marginals by enumeration of all labellings."""

import itertools
import math
import random
import resource

import numpy as np
import pytest

from convolake.llm import quality

TEXTS = ["", "\n", "One line. Two words two words.", "a b b b\nA, 1.5 ü\n\na b b b", "x\ty\r\nend", "### $$ %%%\n### $$ %%%\nlong " + "word " * 30, "é\n" * 5]


def plain_features(line, lines, n):
    raw = line.encode()
    kind = lambda c: 7 if c > 127 else 0 if c in b" \t\r\x0b\x0c" else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c == 46 else 5 if c in b",;:'-" else 6
    out = [0.0] * 78
    long = max(len(raw), 1)
    for a, b in zip(raw, raw[1:]):
        out[kind(a) * 8 + kind(b)] += 4 / long
    for c in raw:
        out[64 + kind(c)] += 1 / long
    words = raw.translate(bytes(32 if c in b" \t\r\x0b\x0c" else c for c in range(256))).split(b" ")
    words = [w for w in words if w]
    echo = sum(a == b for a, b in zip(words, words[1:]))
    out[72:] = [math.log1p(len(raw)) / 5, float(not raw), len(words) / long, echo / max(len(words), 1) * 2, float(bool(raw) and line in lines[:n]), math.log1p(len(lines)) / 5]
    return out


def plain_score(model, text):
    lines = text.split("\n")
    own = [[(f - m) / s for f, m, s in zip(plain_features(x, lines, n), model.mean, model.scale)] for n, x in enumerate(lines)]
    w = model.weights[:-1].reshape(3, 78)
    none = [0.0] * 78
    emit = [np.dot(w[0], o) + np.dot(w[1], own[n - 1] if n else none) + np.dot(w[2], own[n + 1] if n + 1 < len(own) else none) + model.weights[-1] for n, o in enumerate(own)]
    total, good = 0.0, [0.0] * len(lines)
    for y in itertools.product((0, 1), repeat=len(lines)):
        p = math.exp(sum(e * v for e, v in zip(emit, y)) + sum(model.step[a, b] for a, b in zip(y, y[1:])))
        total += p
        for n, v in enumerate(y):
            good[n] += p * v
    sizes = [len(x.encode()) + 1e-9 for x in lines]
    return sum(g / total * s for g, s in zip(good, sizes)) / sum(sizes)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    return quality.Model(rng.normal(size=quality.N_FEATURES) * 0.1, rng.normal(size=(2, 2)), rng.normal(size=78) * 0.1, rng.uniform(0.5, 1, 78))


@pytest.mark.parametrize("block", [(1 << 18, 1 << 13), (20, 2)])
def test_scores_match_the_plain_version(model, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK_BYTES", block[0])
    monkeypatch.setattr(quality, "BLOCK_LINES", block[1])
    want = [plain_score(model, t) for t in TEXTS]
    assert np.allclose(model.scores(TEXTS), want, atol=1e-4)
    assert np.allclose([model.scores([t])[0] for t in TEXTS], want, atol=1e-4)


def test_gradient_is_that_of_the_likelihood():
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["good words here.", "$$ ## 9"]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    labels = [int("good" in t.split("\n")[0]) for t in texts]
    a, b = (quality.fit(texts, labels, rounds) for rounds in (5, 60))

    def loss(m):
        lines = quality.Lines(texts)
        odds = lines.odds(((i, j, (x - m.mean) / m.scale) for i, j, x in lines.own()), m.weights)
        y = np.repeat(labels, np.diff(lines.bound))
        z = quality.marginals(odds, m.step, lines.bound)[2]
        return z - (odds * y).sum() - sum(m.step[v, v] * (n - 1) for v, n in zip(labels, np.diff(lines.bound)))

    assert loss(b) < loss(a)


def test_a_million_lines_take_bounded_memory(model):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    score = model.scores(["\n" * 1_000_000])[0]
    assert 0 <= score <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes
