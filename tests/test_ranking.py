"""Ranks by positions, the stored index and fragments against plain versions."""

import math
import random
import re
from itertools import product

import pytest

from convolake.operators import ranking

WORDS = ["alpha", "beta", "gamma", "x", "y", "z", "Été", "中文"]


def split(text):
    return re.findall(r"[^\W]+", (text or "").lower())


def plain_rank(text, words):
    toks = split(text)
    at = {w: [i for i, t in enumerate(toks) if t == w] for w in words}
    if not all(at.values()):
        return None
    if len(words) == 1:
        return round(0.1 * sum(1 / j**2 for j in range(1, len(at[words[0]]) + 1)) / (math.pi**2 / 6), 6)
    rest = 1.0
    for i, a in enumerate(words):
        for b in words[:i]:
            for p, q in product(at[a], at[b]):
                if abs(p - q) <= 100:
                    rest *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
    return round(1 - rest, 6)


def plain_fragments(text, words, most=2, least=3, longest=14):
    pieces = re.findall(r"(\w+)(\W*)", text or "")
    toks = [p[0].lower() for p in pieces]
    hits = [i for i, t in enumerate(toks) if t in words]
    parts = []
    for _ in range(most):
        options = []
        for h in hits:
            inside = [i for i in hits if h <= i < h + longest]
            if all(h > hi or inside[-1] < lo for lo, hi in parts):
                options.append((len({toks[i] for i in inside}), len(inside), h - inside[-1], -h, inside[-1]))
        if not options:
            break
        best = max(options)
        begin, end = -best[3], best[4]
        low = max([hi + 1 for _, hi in parts if hi < begin], default=0)
        high = min([lo - 1 for lo, _ in parts if lo > end], default=len(toks) - 1)
        lo = max(begin - (longest - (end - begin + 1)) // 2, low)
        hi = min(lo + longest - 1, high)
        lo = max(hi - longest + 1, low)
        if hi - lo + 1 >= least or not parts:
            parts.append((lo, hi))
    if not parts and toks:
        parts = [(0, min(len(toks), least) - 1)]
    mark = lambda i: f"<b>{pieces[i][0]}</b>" if toks[i] in words else pieces[i][0]
    return " ... ".join("".join(mark(i) + (pieces[i][1] if i < hi else "") for i in range(lo, hi + 1)) for lo, hi in sorted(parts))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = {i: rng.choice(["", "- "]) + "".join(rng.choice(WORDS) + rng.choice([" ", ", ", ".\n"]) if rng.random() < 0.3 else f"w{rng.randrange(50)} " for _ in range(rng.randrange(1, 400))) for i in range(60)}
    return out | {100: "alpha " + "w " * 150 + "beta", 101: None, 102: "", 103: "...", 104: "one", 105: "Alpha", 106: "a b c d", 107: "beta x alpha " * 40}


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


@pytest.mark.parametrize("words", [["alpha"], ["alpha", "beta"], ["alpha", "beta", "中文", "été"], ["absent"]])
def test_rank(frame, texts, words):
    got = {r.id: r.rank for r in ranking.rank(ranking.positions(frame), words).collect()}
    want = {i: r for i, t in texts.items() if (r := plain_rank(t, words)) is not None}
    assert got == pytest.approx(want, abs=2e-6) and set(got) == set(want)


@pytest.mark.parametrize("words", [["alpha"], ["alpha", "beta", "中文"], ["absent"]])
def test_fragments(frame, texts, words):
    got = {r.id: r.snippet for r in ranking.fragments(frame, words).collect()}
    assert got == {i: plain_fragments(t, words) for i, t in texts.items() if t is not None} | {101: got[101]}
    assert not got[101]


def test_stored_index(spark, frame, tmp_path):
    index = ranking.StoredIndex(spark, f"file:{tmp_path}/i")
    index.add(frame.where("id < 30"), 1)
    index.add(frame.where("id >= 30"), 2)
    index.add(frame, 2)  # again
    words = ["alpha", "beta"]
    got = index.words(words)
    assert sorted(ranking.rank(got, words).collect()) == sorted(ranking.rank(ranking.positions(frame), words).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    read = {re.search(r"bucket=(\d+)", f)[1] for f in got.inputFiles()}
    assert len(read) > 2  # the folder has many,
    opened = {re.search(r"bucket=(\d+)", r[0])[1] for r in got.selectExpr("input_file_name()").distinct().collect()}
    assert len(opened) == 2  # the search opens two
