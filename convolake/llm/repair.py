"""Repair of the structure of conversations by cheapest edits.

A conversation is right where the initials of its roles are s?(ua)+, or it is empty. Rows may be kept (free),
given the role user or assistant (2) or deleted (3, and required for blank and duplicate rows), and empty turns
of user or assistant may be inserted (2); a truncated row that stays adds 1. Of the cheapest sequences of edits
the ASCII-least string of initials (D, I, K, R) is taken.

The costs are a dynamic program over the four states of that language. Conversations of like length lie side by
side, turns run along the first axis: a step updates the state costs of one turn of all of them at once, from the
last turn to the first, and keeps them; the edits are then read off from the first turn to the last, again for all at
once. Conversations of over LONG turns are cut into segments of LONG turns that lie side by side too: the costs
from each state to each state of a segment are its matrix, matrices are chained, and the edits of every segment
are read off from the entry that the chain gives.

1. `audits` reads a conversation's turns as a few bytes each (initial, faults, digest), in order, and gives its
   figures and its edits as one byte a turn.
2. `replay` puts these in front of the texts, which pass as a stream: no conversation's text is held.

Defined results: order is by turn (nulls first), then role and a digest of role and text; null roles and texts are
one space; a role that begins with another letter than s, u or a can't be kept; a null id is a conversation of its
own; repeated rows are duplicates; other columns are ignored; a conversation without rows has no row here.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .simhash import runs

#: Turns of a segment, rows read at once, segments whose matrices are held at once.
LONG, ROWS, SEGMENTS = 512, 1 << 15, 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after s, after u, after a. Rows: initial s, u, a, other; -1: not allowed.
STEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: The state after the turn that is inserted, or whose role is changed, in each state; and after two of them.
MADE = np.array([2, 2, 3, 2])
TWICE = MADE[MADE]
BIG = np.int64(1) << 40
ACCEPT = np.array([0, BIG, BIG, 0])
#: Turns to insert at the end, by the last state.
TAIL = np.array([0, 2, 1, 0])
EDITS = ("", "D", "K", "R")


def closed(cost: np.ndarray) -> np.ndarray:
    """State costs (…, 4) with up to two insertions first."""
    return np.minimum(np.minimum(cost, cost[..., MADE] + INSERT), cost[..., TWICE] + 2 * INSERT)


def backward(kind, gone, late, there, end) -> np.ndarray:
    """Costs (turns + 1, columns, 4) from before each turn to the end; `end` (columns, 4) are those after the last.

    kind, gone, late, there: (turns, columns) initial, must be deleted, truncated, is a turn at all.
    """
    turns, columns = kind.shape
    cost = np.empty((turns + 1, columns, 4), dtype=np.int64)
    cost[turns] = closed(np.broadcast_to(end, (columns, 4)))
    for t in range(turns - 1, -1, -1):
        later, step = cost[t + 1], STEP[kind[t]]
        keep = np.where(step >= 0, np.take_along_axis(later, np.maximum(step, 0), axis=1), BIG) + KEEP
        stay = np.minimum(keep, later[:, MADE] + REROLE) + (TRUNCATED * late[t])[:, None]
        best = np.minimum(later + DELETE, np.where(gone[t][:, None], BIG, stay))
        cost[t] = np.where(there[t][:, None], closed(best), later)
    return cost


def trace(kind, gone, late, there, cost, at) -> tuple[np.ndarray, np.ndarray]:
    """Edits (turns, columns) of the ASCII-least cheapest way from the states `at`, and the states after the last turn.

    An edit: index of EDITS in two bits, above them the number of insertions before the turn.
    """
    turns, columns = kind.shape
    ops, i, at = np.zeros((turns, columns), dtype=np.uint8), np.arange(columns), at.copy()
    for t in range(turns):
        later, todo = cost[t + 1], there[t].copy()
        for _ in range(3):
            now, step = cost[t, i, at], STEP[kind[t], at]
            drop = todo & (later[i, at] + DELETE == now)
            add = todo & ~drop & (cost[t, i, MADE[at]] + INSERT == now)
            rest = todo & ~drop & ~add
            keep = rest & ~gone[t] & (step >= 0) & (later[i, np.maximum(step, 0)] + TRUNCATED * late[t] + KEEP == now)
            ops[t] += (drop * 1 + keep * 2 + (rest & ~keep) * 3 + add * 4).astype(np.uint8)
            at = np.where(keep, step, np.where(todo & ~drop & ~keep, MADE[at], at))
            todo = add
            if not todo.any():
                break
    return ops, at


def _dense(values, first, size, turns, fill):
    """(turns, columns): column c holds values[first[c] : first[c] + size[c]]."""
    rows = np.arange(turns)[:, None]
    inside = rows < size
    return np.where(inside, values[np.where(inside, first + rows, 0)], fill)


def _columns(kind, gone, late, first, size, turns):
    parts = [_dense(kind, first, size, turns, 3), _dense(gone, first, size, turns, False), _dense(late, first, size, turns, False)]
    return (*parts, np.arange(turns)[:, None] < size)


def solve(kind, gone, late, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits of all turns, insertions at the end and cost of conversations at[i] to at[i + 1]."""
    first, size = at[:-1], np.diff(at)
    ops, tail, cost = np.zeros(len(kind), dtype=np.uint8), np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(bucket[size <= LONG]):
        some = np.flatnonzero((bucket == b) & (size <= LONG))
        turns = int(size[some].max(initial=0))
        cols = _columns(kind, gone, late, first[some], size[some], turns)
        back = backward(*cols, ACCEPT)
        edits, end = trace(*cols, back, np.zeros(len(some), dtype=np.int64))
        cost[some], tail[some] = back[0, :, 0], TAIL[end]
        rows, which = np.nonzero(cols[3])
        ops[first[some][which] + rows] = edits[rows, which]
    for c in np.flatnonzero(size > LONG):
        own = slice(first[c], first[c] + size[c])
        ops[own], tail[c], cost[c] = _long(kind[own], gone[own], late[own])
    return ops, tail, cost


def _long(kind, gone, late):
    """solve() for one conversation, its segments side by side."""
    starts = np.arange(0, len(kind), LONG)
    sizes = np.minimum(LONG, len(kind) - starts)
    blocks = [slice(i, i + SEGMENTS) for i in range(0, len(starts), SEGMENTS)]
    across = np.empty((len(starts), 4, 4), dtype=np.int64)  # to, from
    only = np.where(np.eye(4, dtype=bool), 0, BIG)
    for b in blocks:
        cols = [np.repeat(x, 4, axis=1) for x in _columns(kind, gone, late, starts[b], sizes[b], LONG)]
        across[b] = backward(*cols, np.tile(only, (len(starts[b]), 1)))[0].reshape(-1, 4, 4)
    value = np.empty((len(starts) + 1, 4), dtype=np.int64)
    value[-1] = closed(ACCEPT)
    for s in range(len(starts) - 1, -1, -1):
        value[s] = (across[s] + value[s + 1][:, None]).min(axis=0)
    ops, state = np.zeros((len(starts), LONG), dtype=np.uint8), 0
    for b in blocks:
        cols = _columns(kind, gone, late, starts[b], sizes[b], LONG)
        back = np.repeat(backward(*cols, value[1:][b]), 4, axis=1)
        edits, end = trace(*(np.repeat(x, 4, axis=1) for x in cols), back, np.tile(np.arange(4), len(starts[b])))
        edits, end = edits.reshape(LONG, -1, 4), end.reshape(-1, 4)
        for s in range(len(end)):
            ops[b.start + s] = edits[:, s, state]
            state = end[s, state]
    return ops.ravel()[: len(kind)], TAIL[state], value[0, 0]


def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """_conv (text of the id), turn, role, text, digest: one space for null roles and texts."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv_col).cast("string").alias("_conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    return out.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _order() -> list:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _audited(batches):
    """Of sorted light rows: one row a conversation, its figures and edits."""
    for c, at in runs(batches, ["_conv", "turn", "timed", "kind", "blank", "late", "digest"], ["_conv"], ROWS):
        n, head = len(c["kind"]), at[:-1]
        conv = np.repeat(np.arange(len(head)), np.diff(at))
        sums = lambda x: np.add.reduceat(x.astype(np.int64), head)
        turn, timed = c["turn"], c["timed"].astype(bool)
        fresh = timed & np.concatenate(([True], (conv[1:] != conv[:-1]) | ~timed[:-1] | (turn[1:] != turn[:-1])))
        low = np.minimum.reduceat(np.where(timed, turn, np.iinfo(np.int64).max), head)
        high = np.maximum.reduceat(np.where(timed, turn, np.iinfo(np.int64).min), head)
        gaps = np.where(sums(timed) > 0, high - low + 1 - sums(fresh), 0)
        halves = np.frombuffer(b"".join(c["digest"]), dtype="<u8").reshape(n, 2)
        order = np.lexsort((np.arange(n), halves[:, 0], halves[:, 1], conv))
        same = (conv[order][1:] == conv[order][:-1]) & (halves[order][1:] == halves[order][:-1]).all(axis=1)
        blank, again = c["blank"].astype(bool), np.zeros(n, dtype=bool)
        again[order[1:][same]] = True
        again &= ~blank
        late = c["late"].astype(bool) & ~blank & ~again
        kind = c["kind"].astype(np.int64)
        inner = np.ones(n, dtype=bool)
        inner[head] = False
        before = np.concatenate(([3], kind[:-1]))
        fine = (kind == 1) & ((before == 0) | (before == 2)) | (kind == 2) & (before == 1)
        ops, tail, cost = solve(kind, blank | again, late, at)
        figures = [gaps, sums(blank), sums(again), sums(late), sums(inner & ~fine), cost]
        raw = ops.tobytes()
        edits = pa.array([raw[s:e] for s, e in zip(at, at[1:])], pa.binary())
        yield pa.record_batch([pa.array(c["_conv"][head], pa.string()), *(pa.array(f, pa.int64()) for f in figures), edits, pa.array(tail, pa.int64())], names=["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "edits", "tail"])


def audits(rows: DataFrame) -> DataFrame:
    """Of what _rows() gives, one row a conversation: figures, edits (one byte a turn), insertions at the end."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    late = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("_conv", "turn", "role", "digest", kind.alias("kind"), blank.alias("blank"), late.alias("late"))
    light = light.repartition("_conv").sortWithinPartitions("_conv", *_order()).drop("role")
    light = light.withColumn("timed", F.col("turn").isNotNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    return light.mapInArrow(_audited, f"_conv string, {_FIGURES}, edits binary, tail long")


def _fronted(rows: DataFrame) -> DataFrame:
    """Conversations in order inside partitions: first the row of audits(), then the turns."""
    head = audits(rows).withColumn("_row", F.lit(0))
    both = head.unionByName(rows.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    return both.repartition("_conv").sortWithinPartitions("_conv", "_row", *_order()).drop("digest", "turn")


def _turns(batches):
    """(head row, None) for each conversation, then its repaired turns as (head row, (edit, role, text))."""

    def inserted(head, n):
        for _ in range(n):
            yield head, ("I", say(), "")

    def say():
        nonlocal state
        state = int(MADE[state])
        return "user" if state == 2 else "assistant"

    head, state, i, number = None, 0, 0, 0
    for b in slices(batches, 4096):
        for r in b.to_pylist():
            if r["_row"] == 0:
                if head:
                    yield from inserted(head, head["tail"])
                head, state, i, number = r | {"_number": number}, 0, 0, number + 1
                yield head, None
                continue
            op = head["edits"][i]
            i += 1
            yield from inserted(head, op >> 2)
            if op & 3 == 2:
                state = int(STEP["sua".index(r["role"][0]), state])
                yield head, ("K", r["role"], r["text"])
            elif op & 3 == 3:
                yield head, ("R", say(), r["text"])
            else:
                yield head, ("D", None, None)
    if head:
        yield from inserted(head, head["tail"])


def _batched(rows, names, types, at_least=4096):
    held = [[] for _ in names]
    size = 0
    for row in rows:
        for h, x in zip(held, row):
            h.append(x)
            size += len(x) if isinstance(x, str) else 0
        if len(held[0]) >= at_least or size > 1 << 24:
            yield pa.record_batch([pa.array(h, t) for h, t in zip(held, types)], names=names)
            held, size = [[] for _ in names], 0
    if held[0]:
        yield pa.record_batch([pa.array(h, t) for h, t in zip(held, types)], names=names)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns: id, position (from 0), role, text, edit (K, R or I)."""

    def repaired(batches):
        def out():
            for _, turns in groupby(_turns(batches), key=lambda x: x[0]["_number"]):
                kept = ((head, turn) for head, turn in turns if turn and turn[0] != "D")
                for at, (head, (edit, role, text)) in enumerate(kept):
                    yield head["_conv"], at, role, text, edit

        yield from _batched(out(), ["_conv", "position", "role", "text", "edit"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])

    kind = rows.schema[conv_col].dataType
    out = _fronted(_rows(rows, conv_col, turn_col, role_col, text_col)).mapInArrow(repaired, "_conv string, position long, role string, text string, edit string")
    return out.select(F.col("_conv").cast(kind).alias(conv_col), "position", "role", "text", "edit")


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: figures, audit (initials of the edits in order), digest of the repaired turns."""
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def reported(batches):
        def out():
            for _, turns in groupby(_turns(batches), key=lambda x: x[0]["_number"]):
                audit, sha, gap = [], hashlib.sha256(), ""
                for of, turn in turns:
                    if not turn:
                        continue
                    audit.append(turn[0])
                    if turn[0] != "D":
                        sha.update(f"{gap}{turn[1]}:{turn[2]}".encode())
                        gap = "\n"
                yield of["_conv"], *(of[f] for f in figures), "".join(audit), sha.hexdigest()

        yield from _batched(out(), ["_conv", *figures, "audit", "repaired_sha256"], [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()])

    kind = rows.schema[conv_col].dataType
    out = _fronted(_rows(rows, conv_col, turn_col, role_col, text_col)).mapInArrow(reported, f"_conv string, {_FIGURES}, audit string, repaired_sha256 string")
    return out.select(F.col("_conv").cast(kind).alias(conv_col), *figures, "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with a fifth to a quarter of their rows spoilt, by a checksum of id and turn: dropped (0),
    emptied (1), without ends of sentences (2), repeated (3), said by the user (4). Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))).withColumn("text", text)
    return rows.withColumn("_copy", F.explode(F.expr("if(hit = 3, array(0, 1), array(0))"))).select("conv_id", "turn", "role", "text")


def repaired_report(conversations: DataFrame) -> DataFrame:
    """report() of damaged conversations, with a row for every id that was given."""
    ids = conversations.select("conv_id").distinct()
    done = report(damage(conversations)).withColumnRenamed("conv_id", "_id")
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": nothing})
