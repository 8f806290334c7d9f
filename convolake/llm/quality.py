"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of byte classes and of their successions, its
size, how it repeats, and the same features of the lines before and after; transitions tie
neighbours. Forward-backward gives each line's marginal probability to be good, and a document's
score is their mean weighted by line length.

Features are computed for blocks of lines and reduced to a line's three products with the weights
(as itself, as the line before, as the line after) at once, so that a text of a million lines takes
some hundred bytes a line. A single line is handled whole.

Training lines carry the label of their document. The fit uses a bounded sample: at most
TRAIN_DOCS labelled documents in the order of a hash of their ids, of each at most TRAIN_CHARS
characters (a window at a place drawn by the hash), and never a document whose crc32(id) mod 3 is 1.

Defined results: null and empty texts are one empty line and get a score; null labels and labels
of unknown documents teach nothing, several labels of one document count by their mean; without
any label of either class every score is 0.5; repeated rows come back as often as given; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import slices
from .vocab import chunks_of

TRAIN_DOCS, TRAIN_CHARS, ROUNDS, PENALTY = 2000, 20_000, 100, 1e-3
#: Bytes and lines of a block of lines whose features are held at once.
BLOCK_BYTES, BLOCK_LINES = 1 << 18, 1 << 13

# byte classes: space, lower, upper, digit, stop, comma, other marks, beyond ASCII
_CLASS = np.full(256, 6, dtype=np.int64)
for _n, _bytes in enumerate((b" \t\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",;:'-")):
    _CLASS[list(_bytes)] = _n
_CLASS[128:] = 7
_OWN = 64 + 8 + 6
#: Weights of a line's own features, of the line before, of the line after, and the constant.
N_FEATURES = 3 * _OWN + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges starts[i]:ends[i]."""
    m = 0x9E3779B97F4A7C15
    up, down = (np.full(len(data) + 1, x, dtype=np.uint64) for x in (m, pow(m, -1, 1 << 64)))
    up[0] = down[0] = 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up)[:-1], out=total[1:])
    return (total[ends] - total[starts]) * np.multiply.accumulate(down)[starts]


class Lines:
    """The lines of some texts: sizes in bytes, the range of each text's lines, and features block by block."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self.ends = np.flatnonzero(self.data == 10)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        self.size = self.ends - self.starts
        self.bound = np.concatenate(([0], np.searchsorted(self.ends, np.cumsum([len(r) + 1 for r in raw]))))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bound))
        digest = np.concatenate([_hashes(self.data[self.starts[i] : self.ends[j - 1] + 1], self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i]) for i, j in self._blocks()])
        # lines that say what an earlier one of their text said
        order = np.lexsort((digest, self.text))
        same = (digest[order][1:] == digest[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])
        self.again = np.zeros(len(self.ends), dtype=bool)
        self.again[order[1:][same]] = True
        #: has the line one before it, one after it, in its text?
        self.linked = self.text[1:] == self.text[:-1]

    def _blocks(self):
        i = 0
        while i < len(self.ends):
            j = int(np.searchsorted(self.ends, self.starts[i] + BLOCK_BYTES))
            j = max(i + 1, min(j, i + BLOCK_LINES))
            yield i, j
            i = j

    def own(self):
        """(i, j, features of lines i:j) for all blocks of lines."""
        many = np.log1p(np.diff(self.bound))
        for i, j in self._blocks():
            data = self.data[self.starts[i] : self.ends[j - 1] + 1]
            ends, size, n = self.ends[i:j] - self.starts[i], self.size[i:j], j - i
            line = np.repeat(np.arange(n), size + 1)
            kind = _CLASS[data]
            inner = data != 10
            follows = inner[1:] & inner[:-1]
            pairs = np.bincount(line[1:][follows] * 64 + kind[:-1][follows] * 8 + kind[1:][follows], minlength=n * 64).reshape(n, 64)
            single = np.bincount(line[inner] * 8 + kind[inner], minlength=n * 8).reshape(n, 8)
            long = np.maximum(size, 1)[:, None]
            # words that repeat the one before them, by hashes of their bytes
            gap = kind == 0
            gap[ends] = True
            opens = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
            words = np.bincount(line[opens], minlength=n)
            said = _hashes(data, opens, np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1]))))
            echo = np.bincount(line[opens[1:]][(said[1:] == said[:-1]) & (line[opens[1:]] == line[opens[:-1]])], minlength=n)
            extra = np.stack([np.log1p(size) / 5, size == 0, words / long[:, 0], echo / np.maximum(words, 1) * 2, self.again[i:j] & (size > 0), many[self.text[i:j]] / 5], axis=1)
            yield i, j, np.concatenate([pairs / long * 4, single / long, extra], axis=1).astype(np.float32)

    def odds(self, own, weights: np.ndarray) -> np.ndarray:
        """Log odds of all lines to be good, from blocks (i, j, features) and the weights."""
        parts = weights[:-1].reshape(3, _OWN).T
        product = np.concatenate([x @ parts for _, _, x in own])
        out = product[:, 0] + weights[-1]
        out[1:] += np.where(self.linked, product[:-1, 1], 0)
        out[:-1] += np.where(self.linked, product[1:, 2], 0)
        return out


class _Lattice:
    """Rows of lines by place in their text: at place t, the texts (longest first) with more than t lines."""

    def __init__(self, bound: np.ndarray):
        count = np.diff(bound)
        order = np.argsort(-count, kind="stable")
        self.first, self.places = bound[:-1][order], int(count.max(initial=0))
        self.many = np.searchsorted(-count[order], -np.arange(1, self.places + 1), side="right")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.many[t]] + t


def marginals(emit: np.ndarray, step: np.ndarray, bound: np.ndarray, gradient: bool = True):
    """(P(good) of each line, expected transitions 2 x 2, log partition) for log odds emit and log transitions step.

    Messages go forward and back through all texts side by side; without gradient the last two are None.
    """
    lattice, n = _Lattice(bound), len(emit)
    score = np.stack([np.zeros(n), emit], axis=1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(lattice.places):
        at = lattice.at(t)
        ahead[at] = score[at]
        if t:
            prev = at - 1
            ahead[at] += np.logaddexp(ahead[prev, 0][:, None] + step[0], ahead[prev, 1][:, None] + step[1])
    for t in range(lattice.places - 1, 0, -1):
        at = lattice.at(t)
        v = back[at] + score[at]
        back[at - 1] = np.logaddexp(v[:, 0][:, None] + step[:, 0], v[:, 1][:, None] + step[:, 1])
    both = ahead + back
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    if not gradient:
        return good, None, None
    linked = np.ones(n, dtype=bool)
    linked[bound[:-1]] = False
    at = np.flatnonzero(linked)
    v = back[at] + score[at] - z[at][:, None]
    moves = np.exp(ahead[at - 1][:, :, None] + step + v[:, None, :]).sum(axis=0)
    return good, moves, float(z[bound[:-1]].sum()) if n else 0.0


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    flat: bool = False

    def scores(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, for each text."""
        if self.flat or not texts:
            return np.full(len(texts), 0.5)
        lines = Lines(texts)
        own = ((i, j, (x - self.mean) / self.scale) for i, j, x in lines.own())
        good, _, _ = marginals(lines.odds(own, self.weights), self.step, lines.bound, gradient=False)
        weight = lines.size + 1e-9
        total = np.add.reduceat(good * weight, lines.bound[:-1])
        return np.clip(total / np.add.reduceat(weight, lines.bound[:-1]), 0.0, 1.0)


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model:
    """Maximum likelihood by Adam over all given documents, with an L2 penalty."""
    if not texts or len(set(labels)) < 2:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(_OWN), np.ones(_OWN), flat=True)
    lines = Lines(texts)
    x = np.empty((len(lines.size), _OWN), dtype=np.float32)  # the driver's largest array
    for i, j, own in lines.own():
        x[i:j] = own
    y = np.repeat(np.array(labels), np.diff(lines.bound))
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.array(labels), np.array(labels)), np.diff(lines.bound) - 1)
    d, params, m, v = N_FEATURES, np.zeros(N_FEATURES + 4), 0.0, 0.0
    for t in range(1, rounds + 1):
        w, step = params[:d], params[d:].reshape(2, 2)
        good, moves, _ = marginals(lines.odds([(0, len(x), x)], w.astype(np.float32)).astype(np.float64), step, lines.bound)
        miss = (good - y).astype(np.float32)
        # a line's error falls on itself, and on the lines before and after it by their own features
        sides = np.stack([miss, np.append(np.where(lines.linked, miss[1:], 0), 0), np.append(0, np.where(lines.linked, miss[:-1], 0))])
        grad = np.concatenate([(sides.astype(np.float32) @ x).ravel(), [miss.sum(dtype=np.float64)], (moves - seen).ravel()]) / len(y) + PENALTY * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(params[:d], params[d:].reshape(2, 2), mean, scale)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    taught = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    taught = taught.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample's size is fixed, so it may be broadcast
    picked = taught.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(TRAIN_DOCS)
    place = F.when(F.length("text") > TRAIN_CHARS, F.pmod(F.xxhash64("id"), F.length("text") - TRAIN_CHARS)).otherwise(0) + 1
    window = F.substring("text", place.cast("int"), F.lit(TRAIN_CHARS))
    # of rows that share an id one teaches, so that no id can flood the driver
    sample = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct(window.alias("text"), "y")).alias("s")).orderBy("id").select("s.*").collect()
    return fit([r.text for r in sample], [r.y for r in sample])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= 0.5)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = shared.value
        for b in slices(batches):
            scores = [model.scores(part) for part in chunks_of(b.column("text").to_pylist(), 1 << 18)]
            yield pa.record_batch([b.column("id"), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["id", "score"])

    out = frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs whose text scores 0.5 or more, with all their columns; rows are judged where they are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    frame = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = shared.value
        for b in slices(batches):
            scores = [model.scores(part) for part in chunks_of(b.column("text").to_pylist(), 1 << 18)]
            good = np.concatenate(scores) >= 0.5 if scores else np.zeros(0, dtype=bool)
            yield pa.record_batch([b.column("row").filter(pa.array(good))], names=["row"])

    schema = StructType([StructField("row", docs.schema)])
    return frame.mapInArrow(run, schema).select("row.*")
