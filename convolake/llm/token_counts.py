"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one ragged numpy array. Each round finds every sequence's lowest
merge rank and applies that pair in all sequences at once; a sequence leaves when no pair of it
has a rank. What survives of a sequence is its number of tokens.

Sequences of over LONG bytes are first cut where no merge can join two bytes, which changes nothing. What is
still long is merged through positions held by rank: a round takes the lowest rank of all sequences (which is
the lowest of each that has it), and only the pairs beside what it merged are ranked again, so a word without
a break costs about its length, not its square.

Defined results: null texts count as empty (0 tokens, 0 bytes); texts and words of any length are taken
whole; repeated rows come back as often as given; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .common import slices

_NONE = np.int64(1 << 40)
#: Bytes of a sequence that is no longer ranked whole in every round.
LONG = 256


class RankMerger:
    def __init__(self, vocabulary: V.Vocabulary):
        m = np.array(vocabulary.merges, dtype=np.int64).reshape(-1, 3)
        keys = m[:, 0] << 20 | m[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), m[:, 2]
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int64)
        ends = {i: (b, b) for b, i in enumerate(vocabulary.byte_ids)}
        #: whether some merge joins a symbol that ends with the first byte and one that begins with the second
        self.joins = np.zeros((256, 256), dtype=bool)
        for left, right, both in vocabulary.merges:
            self.joins[ends[left][1], ends[right][0]] = True
            ends[both] = (ends[left][0], ends[right][1])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.ranks[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive all merges, for each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        long = np.flatnonzero(sizes > LONG)
        if not len(long):
            return self._together(words)
        out = np.zeros(len(words), dtype=np.int64)
        short = np.flatnonzero(sizes <= LONG)
        out[short] = self._together([words[i] for i in short])
        for i in long:
            parts = self._parts(words[i])
            out[i] = self._together([p for p in parts if len(p) <= LONG]).sum() + sum(self._by_rank(p) for p in parts if len(p) > LONG)
        return out

    def _parts(self, word: bytes) -> list[bytes]:
        """The word, cut between bytes that no merge joins."""
        raw = np.frombuffer(word, dtype=np.uint8)
        at = np.concatenate(([0], np.flatnonzero(~self.joins[raw[:-1], raw[1:]]) + 1, [len(raw)]))
        return [word[s:e] for s, e in zip(at.tolist(), at[1:].tolist())]

    def _by_rank(self, word: bytes) -> int:
        """Symbols that survive of one long sequence: a linked list, its pairs in heaps by rank."""
        n = len(word)
        sym = np.append(self.byte_ids[np.frombuffer(word, dtype=np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # the element n is the end
        rank = np.append(self._ranks(sym[: n - 1], sym[1:n]), [_NONE, _NONE])
        held, order = {}, []

        def hold(at):
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            first = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
                r = int(rank[at[s]])
                if r not in held:
                    held[r] = []
                    heappush(order, r)
                held[r].append(at[s:e])

        hold(np.arange(n))
        left = n
        while order:
            r = heappop(order)
            at = np.unique(np.concatenate(held.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # in a run of overlapping matches (aaa) every second one is taken, from the left
            starts = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            rank[gone] = _NONE
            sym[at] = self.merged[r]
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            changed = np.unique(np.concatenate((at, before[at][before[at] >= 0])))
            following = after[changed]
            rank[changed] = np.where(following < n, self._ranks(sym[changed], sym[np.minimum(following, n)]), _NONE)
            hold(changed)
        return left

    def _together(self, words: list[bytes]) -> np.ndarray:
        """count() of short sequences, all pairs ranked in every round."""
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        out = sizes.copy()
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        while len(sym) > 1:
            rank = np.where(seq[1:] == seq[:-1], self._ranks(sym[:-1], sym[1:]), _NONE)
            rank = np.append(rank, _NONE)
            first = np.concatenate(([0], np.flatnonzero(seq[1:] != seq[:-1]) + 1))
            lowest = np.minimum.reduceat(rank, first)
            low = np.repeat(lowest, np.diff(np.append(first, len(sym))))
            open_ = low < _NONE
            here = np.flatnonzero((rank == low) & open_)
            if not len(here):
                break
            # in a run of overlapping matches (aaa) every second one is taken, from the left
            starts = np.concatenate(([True], here[1:] != here[:-1] + 1))
            run = np.maximum.accumulate(np.where(starts, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - run) % 2 == 0]
            sym[here] = self.merged[rank[here]]
            out -= np.bincount(seq[here], minlength=len(out))
            open_[here + 1] = False
            sym, seq = sym[open_], seq[open_]
        return out


@lru_cache(maxsize=4)
def _merger(path: str) -> RankMerger:
    return RankMerger(V.load(path))


class Counter:
    """Counts tokens of texts; remembers words it has counted, up to a bound."""

    def __init__(self, path: str):
        self.merger, special = _merger(path), V.load(path).special
        self.split, self.special, self.known = V.splitter(special), special, V.Memory()

    def count(self, texts: list) -> list[int]:
        out = []
        for part in V.chunks_of(texts):
            words = [self.split(t) for t in part]
            self.known.make_room()
            met = {w for ws in words for w in ws}
            plain = [w for w in met if w not in self.known and w not in self.special]
            self.known.keep(zip(plain, self.merger.count([w.encode() for w in plain]).tolist()))
            self.known.update(dict.fromkeys(self.special, 1))
            out += [sum(map(self.known.__getitem__, ws)) for ws in words]
        return out


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = path or V.default_path()
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counter = _counter(path)  # one a worker, kept between tasks
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            yield pa.record_batch([b.column("id"), sizes, pa.array(counter.count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = frame.schema["id"].dataType.simpleString()
    out = frame.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
