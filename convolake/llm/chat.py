"""Chat formatting in budgeted windows.

Turns of a conversation are laid out in windows of at most `budget` tokens, counted on the turns
as formatted. Prefix sums of turn tokens choose turn-aligned spans; every window starts with the
conversation's system turn, then repeats at most `history` tokens (and HISTORY_TURNS turns) before
its span. Only the assistant turns of the span itself are targets, so a repeated turn is masked and
each target occurs once. Where a turn doesn't fit beside what is repeated, the oldest history goes
first and the system turn last; a turn larger than the budget is a window alone; nothing is cut.

Template: ``### role: text</turn>`` and a newline. A backslash precedes each backslash, ``### ``
and ``</turn>`` of a text (in a role also each colon), which unescaping undoes.

Defined results: null texts and roles are empty; rows without conversation id form one
conversation; equal turns are ordered by role, then text; repeated rows are turns of their own;
an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .token_counts import Counter

BUDGET, HISTORY, HISTORY_TURNS = 512, 128, 8

_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def lay_out(role: str, text: str) -> tuple[str, int, int]:
    """A turn by the template, and where its text starts and ends in it."""
    head = "### " + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted window; text that the template cannot have made is an error."""
    out, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Windows:
    """Windows of one conversation, turn by turn; holds one window and the history before it."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.past, self.span, self.number = None, [], [], 0
        self.total, self.start = 0, 0  # prefix sum of tokens so far, and where the span started
        self.alone = False  # the span's first turn leaves no room for the system turn

    def add(self, role: str, text: str, tokens: int):
        """A finished window if the turn doesn't fit in the one that is open, else None."""
        out = None
        if self.span and self._held() + self.total - self.start + tokens > self.budget:
            out = self.close()
        if not self.span:
            while self.past and self._held() + tokens > self.budget:
                self.past.pop(0)
            self.alone = self._held() + tokens > self.budget
        if self.system is None and not self.number and not self.span and role == "system":
            self.system = (role, text, tokens)
        self.total += tokens
        self.span.append((role, text, tokens, self.total))
        return out

    def _held(self) -> int:
        return sum(t[2] for t in self._retained() + self.past)

    def _retained(self) -> list:
        return [self.system] if self.system and self.number and not self.alone else []

    def close(self):
        retained = self._retained()
        parts, starts, ends, at = [], [], [], 0
        for n, (role, text, *_) in enumerate(retained + self.past + self.span):
            said, a, b = lay_out(role, text)
            parts.append(said)
            if n >= len(retained) + len(self.past) and role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            at += len(said)
        row = (self.number, len(retained) + len(self.past), len(self.span), "".join(parts), starts, ends)
        first = 1 if self.system and not self.number else 0
        # the longest run of turns before the next span whose tokens, by prefix sums, stay in the history's budget
        recent = (self.past + self.span[first:])[-HISTORY_TURNS:]
        self.past = [t for t in recent if self.total - t[3] + t[2] <= self.history]
        self.number, self.span, self.start, self.alone = self.number + 1, [], self.total, False
        return row


_WINDOW = "window int, n_repeated int, n_turns int, text string, target_starts array<int>, target_ends array<int>"


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conversation, window number, repeated and own turns, text, target ranges (code points)."""
    if history >= budget:
        raise ValueError("the history must leave room in the budget")
    path = path or V.default_path()
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches):
        counter, conv, open_, done = Counter(path), None, None, []

        def batch():
            cols = list(zip(*done)) or [()] * 7
            kinds = [b.schema.field("conv").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["conv", "window", "n_repeated", "n_turns", "text", "target_starts", "target_ends"])

        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            # a turn ends with a newline and the next one starts with a mark, so no token spans two turns
            sizes = counter.count([lay_out(r, t)[0] for r, t in zip(roles, texts)])
            for c, role, text, n in zip(b.column("conv").to_pylist(), roles, texts, sizes):
                if open_ is None or c != conv:
                    if open_:
                        done.append((conv, *open_.close()))
                    conv, open_ = c, _Windows(budget, history)
                if row := open_.add(role, text, n):
                    done.append((conv, *row))
            yield batch()
            done = []
        if open_:
            done = [(conv, *open_.close())]
            yield batch()

    return dealt.mapInArrow(run, f"conv {kind}, {_WINDOW}").withColumnRenamed("conv", conv_col)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What windows say when read back, one row per conversation."""
    rows = formatted.withColumnRenamed(conv_col, "conv")
    kind = rows.schema["conv"].dataType.simpleString()
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "window")

    def run(batches):
        conv, open_, done = None, None, []

        def end():
            n, turns, chars, loss, total = open_
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        def batch():
            cols = list(zip(*done)) or [()] * 6
            kinds = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for r in b.to_pylist():
                if open_ is None or r["conv"] != conv:
                    if open_:
                        done.append(end())
                    conv, open_ = r["conv"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["text"])[r["n_repeated"] :]:
                    open_[0] += 1
                    open_[1].update(f"{role}\n{text}\n".encode())
                for x, y in zip(r["target_starts"], r["target_ends"]):
                    text = unescape(r["text"][x:y])
                    open_[2] += len(text)
                    open_[3].update(text.encode())
                open_[4] += len(r["text"])
            yield batch()
            done = []
        if open_:
            done = [end()]
            yield batch()

    out = dealt.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)
