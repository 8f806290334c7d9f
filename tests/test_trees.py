"""Order of reading against a plain depth-first walk."""

import random
from datetime import datetime, timedelta

import pytest

from convolake.operators import trees

SCHEMA = "session_id long, node string, parent string, ts timestamp, seq long, hidden boolean, text string"
T0 = datetime(2025, 1, 1)


def walk(rows):
    """rows of one session in order of arrival: (node, parent, ts, hidden)."""
    last = {}
    for r in rows:
        last[r[0]] = r
    nodes = list(last.values())
    when = lambda r: r[2] or datetime.min
    children = {}
    for r in nodes:
        children.setdefault(r[1], []).append(r)
    for c in children.values():
        c.sort(key=when)
    if None not in children:
        return [r[0] for r in nodes]
    out, seen, stack = [], set(), [(r, False) for r in reversed(children[None])]
    while stack:
        r, below = stack.pop()
        seen.add(r[0])
        if not below:
            out.append(r[0])
        stack += [(c, below or r[3]) for c in reversed(children.get(r[0], []))]
    if len(out) < len(nodes) * 0.9:
        out += [r[0] for r in sorted((r for r in nodes if r[0] not in seen), key=when)]
    return out


def shown(spark, sessions):
    rows = [(s, *r[:3], i, r[3], "x") for s, rs in sessions.items() for i, r in enumerate(rs)]
    got = {}
    for r in trees.reading_order(spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "place").collect():
        assert r.place == len(got.setdefault(r.session_id, []))
        got[r.session_id].append(r.node)
    return got


def test_reading_order(spark):
    rng = random.Random(4)
    sessions = {}
    for s in range(80):
        n = rng.randrange(1, 30)
        parent = lambda i: None if rng.random() < 0.15 or not i else f"n{rng.randrange(i)}" if rng.random() < 0.85 else rng.choice(["gone", f"n{rng.randrange(n)}"])  # noqa: E731, B023
        rows = [(f"n{i}", parent(i), None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(8)), rng.random() < 0.1) for i in range(n)]
        if s % 3 == 0:
            rows += rng.sample(rows, min(3, n))  # again, with other values
            rows += [(r[0], None, T0, False) for r in rng.sample(rows, 1)]
        if s % 7 == 0:
            rows = [(a, "gone" if b is None else b, t, h) for a, b, t, h in rows]  # no root
        sessions[s] = rows
    want = {s: walk(r) for s, r in sessions.items()}
    got = shown(spark, sessions)
    assert {s: w for s, w in want.items() if w} == got
    assert any(len(w) > 12 for w in want.values())


@pytest.mark.parametrize("n", [10_000])
def test_deep_and_wide(spark, n):
    deep = [(f"n{i}", f"n{i - 1}" if i else None, T0, False) for i in range(n)]
    wide = [(f"n{i}", "n0" if i else None, T0 - timedelta(seconds=i), False) for i in range(3000)]
    got = shown(spark, {1: deep, 2: wide})
    assert got[1] == [f"n{i}" for i in range(n)]
    assert got[2] == ["n0"] + [f"n{i}" for i in range(2999, 0, -1)]


def test_empty(spark):
    assert trees.reading_order(spark.createDataFrame([], SCHEMA)).count() == 0
