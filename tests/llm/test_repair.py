"""Repair of conversations against a search over all edits, by cost and then by the string of edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from convolake.llm import repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """rows: (role, text, must go, truncated). Dijkstra on (cost, edits); the first accepted is the answer."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for x in "ua":
            if (state, x) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, x], (*out, f"{FULL[x]}:")))
        if i < len(rows):
            role, text, gone, late = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not gone:
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, NEXT[state, role[:1]], (*out, f"{role}:{text}")))
                for x in "ua":
                    if (state, x) in NEXT:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, NEXT[state, x], (*out, f"{FULL[x]}:{text}")))


def judged(rows):
    """rows: (turn, role, text) in order; the report's figures."""
    faults, seen, marked = defaultdict(int), set(), []
    for _, role, text in rows:
        fault = None
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not solid:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif solid[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(marked)
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def ordered(rows):
    byconv = defaultdict(list)
    for conv, turn, role, text in rows:
        byconv[conv].append((turn, role, text))
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), digest(x))) for c, r in byconv.items()}


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", " ", "", None, "Why?\n", "é中 ok.", "tab\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"]
    rows = [(c, rng.choice([t, t, t, None, t + 1]), rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 12))]
    rows += [(500, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(200)]
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", "ho."), (None, 1, "assistant", "ho.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, cost string, edits string, tail string"


def test_report(spark, table):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_report(frame).collect()}
    rows = ordered(spoilt(table))
    want = {c: judged(rows.get(c, []))[0] for c in {r[0] for r in table}}
    assert {c: want[c] == got.get(c) for c in want} == dict.fromkeys(want, True)
    assert len(got) == len(want)
    assert {e for w in want.values() for e in w[6]} == set("DIKR")


def test_repaired_turns(spark, table):
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    rows = ordered([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in table])
    got = defaultdict(list)
    for r in repair.repair(frame).orderBy("conv_id", "position").collect():
        assert r.position == len(got[r.conv_id])
        got[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(tuple(got[c]) == judged(r)[1] for c, r in rows.items())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns)) for turns in got.values())


@pytest.mark.parametrize("segments", [1, 3, 512])
def test_long_conversations_in_segments(monkeypatch, segments):
    monkeypatch.setattr(repair, "SEGMENTS", segments)
    rng = np.random.default_rng(2)
    sizes = [0, 1, 7, 8, 9, 64, 100, 333]
    n, at = sum(sizes), np.concatenate(([0], np.cumsum(sizes)))
    kind, gone, late = rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.3
    whole = repair.solve(kind, gone, late & ~gone, at)
    monkeypatch.setattr(repair, "LONG", 8)
    parts = repair.solve(kind, gone, late & ~gone, at)
    assert all((a == b).all() for a, b in zip(whole, parts))
    for i, size in enumerate(sizes):
        own = slice(at[i], at[i + 1])
        cost, audit, _ = cheapest([("suax"[k], "", g, l) for k, g, l in zip(kind[own], gone[own], late[own] & ~gone[own])])
        said = "".join("I" * (op >> 2) + repair.EDITS[op & 3] for op in whole[0][own]) + "I" * whole[1][i]
        assert (int(whole[2][i]), said) == (cost, audit)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repaired_report(none).count() == 0 and repair.repair(none).count() == 0
    assert repair.report(none).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_ids_of_other_kinds(spark):
    frame = spark.createDataFrame([Row(conv_id="b", turn=3, role="user", text="q?")])
    assert [tuple(r) for r in repair.repair(frame).collect()] == [("b", 0, "user", "q?", "K"), ("b", 1, "assistant", "", "I")]
