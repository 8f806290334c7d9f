"""BPE encoding by a deterministic token automaton, and decoding by its arc labels.

The automaton starts as one state with an arc for each byte. Merges are compiled in order: the
gadget of merge (a, b) -> c gives all a-arcs a new target, a copy of the old one without its
b-arc, and every state with an a-arc an arc c to where b led. All arcs of one label share one
target, so a state is named by the label that leads to it, and a gadget is stored as its difference
from the state it copies: arc b, gone from state a since merge number k. Every byte string then
has one path, its tokenization.

Defined results: null texts are empty (no ids); texts are taken whole; repeated rows come back
as often as given; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .common import slices

_START = -1


class Automaton:
    def __init__(self, vocabulary: V.Vocabulary):
        self.labels, self.special = vocabulary.labels, vocabulary.special
        self.born = dict.fromkeys(vocabulary.byte_ids, 0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.gone: dict[tuple[int, int], int] = {}  # (state's label, arc) -> merge that took the arc away
        self.table: dict[tuple[int, int], bool] = {}
        arcs = set(vocabulary.byte_ids)
        for k, (a, b, c) in enumerate(vocabulary.merges, 1):
            if c in self.born or a not in arcs or b not in arcs or not self._has(a, b):
                continue  # b never follows a: the gadget would change nothing
            self.gone[a, b] = k
            self.parts[c], self.born[c] = (a, b), k
            arcs.add(c)
        #: For quick words: START has every arc, so a word that is a label is one arc.
        self.by_text = {self.labels[t]: t for t in arcs}
        self.prefixes = {x[:i] for x in self.by_text for i in range(1, len(x) + 1)}

    def _has(self, state: int, arc: int) -> bool:
        """Has the state that label `state` leads to an arc labelled `arc`?"""
        born, time = self.born, 1 << 60
        while True:
            if self.gone.get((state, arc), time + 1) <= time:
                return False
            s, t = born[state], born[arc]
            if not s and not t:
                return True
            if t >= s:  # the arc is younger: it is there where its left part's arc is
                time, arc = min(time, t), self.parts[arc][0]
            else:  # the state is a copy of the one that its right part led to
                time, state = min(time, s - 1), self.parts[state][1]

    def step(self, state: int, arc: int) -> bool:
        """Table-driven transition; the table is filled as arcs are asked for, and bounded."""
        if state == _START:
            return True
        if (found := self.table.get((state, arc))) is None:
            if len(self.table) > 1 << 20:
                self.table.clear()
            found = self.table[state, arc] = self._has(state, arc)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the one path that spells word."""
        if (whole := self.by_text.get(word)) is not None:
            return [whole]
        n = len(word)
        label, back = [None] * (n + 1), [0] * (n + 1)
        label[0] = _START
        for i in range(n):
            state = label[i]
            for j in range(i + 1, n + 1):
                part = word[i:j]
                if part not in self.prefixes:
                    break
                if (t := self.by_text.get(part)) is not None and label[j] is None and self.step(state, t):
                    label[j], back[j] = t, i
        out, j = [], n
        while j:
            out.append(label[j])
            j = back[j]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text that the arc labels spell; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(V.load(path))


class Encoder:
    """Texts to ids (little-endian uint32 bytes); remembers the words it has met, up to a bound."""

    def __init__(self, path: str):
        self.machine = automaton(path)
        self.split, self.known = V.splitter(self.machine.special), V.Memory()

    def _word(self, word: str) -> bytes:
        special = self.machine.special.get(word)
        ids = self.machine.encode_word(word.encode()) if special is None else [special]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        words = self.split(text or "")
        known = self.known
        known.make_room()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            known.keep([(w, self._word(w)) for w in dict.fromkeys(words) if w not in known])
            return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids (if asked), digests of the ids and of the decoded text, decoded (if asked)."""
    path = path or V.default_path()
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches):
        encoder = _encoder(path)  # one a worker, kept between tasks
        labels = encoder.machine.labels
        for b in slices(batches):
            rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in b.column("text").to_pylist():
                raw = encoder.encode(text)
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                said = b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                if keep_ids:
                    rows["ids"].append(raw)
                if keep_text:
                    rows["decoded"].append(said)
            cols = [b.column("id"), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = cols + [pa.ListArray.from_arrays(np.cumsum([0, *rows["n_tokens"]]).astype(np.int32), pa.array(np.frombuffer(b"".join(rows["ids"]), dtype="<i4")))], names + ["ids"]
            if keep_text:
                cols, names = cols + [pa.array(rows["decoded"], pa.string())], names + ["decoded"]
            yield pa.record_batch(cols, names=names)

    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)
