"""Benchmark decontamination by winnowing.

Both sides keep the minimum K-gram hash (of equal ones the last) of every window of SPAN - K + 1
consecutive word K-grams, so that every shared run of SPAN words shares a fingerprint. An item of
fewer than SPAN words is one window, and the hash of all its words is its fingerprint.

1. A text's fingerprints that pass a bit table of the benchmark's fingerprints (of TABLE words, whatever
   the size of the benchmark) are kept; texts with none are clean.
2. They are joined with the benchmark's fingerprints. Texts alike are one text here, so that copies
   neither repeat work nor make a hot key.
3. Hits are extended: the SPAN-word windows around a hit are joined with the benchmark's windows by a
   128-bit digest of their words. Windows that agree are hit words, and name the items.

Defined results: null or wordless texts have no words and no hits; null or wordless items never
occur; an item without id is reported as "null"; repeated rows come back as often as given; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .vocab import chunks_of

SPAN, K = 13, 5
#: 64-bit words of the bit table that spares texts without a common fingerprint the join.
TABLE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_VALUE = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
#: Bits of a place among the words of a run of texts.
_PLACE = np.uint64((1 << 28) - 1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("m", ())) < n:
        size = 1 << max(12, n.bit_length())
        for name, base in (("m", _M), ("inv", _M_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["m"], _powers["inv"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of texts side by side: their hashes, bytes, and the range of each text's words."""

    folded, inside = _LOWER, _WORD

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.data = self.folded[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
        word = self.inside[self.data]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.data)
        m, inv = _power(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.data] * m[:n], out=total[1:])
        self.hash = _mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))
        self.bound = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bound))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words from each position, and whether they lie in one text."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        h = self.hash[:size].copy()
        for j in range(1, n):
            h = h * _M + self.hash[j : size + j]
        return _mix(h), self.text[:size] == self.text[n - 1 :]

    def anchors(self, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window of span words the place of its least k-gram (of equal ones the last), whether it lies in one text, and all k-grams.

        A k-gram is compared by its hash's upper bits, then by its place: minima of windows by doubling.
        """
        h, _ = self.grams(k)
        width = span - k + 1
        size = max(len(h) - width + 1, 0)
        if not size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), h
        low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        done = 1
        while done * 2 <= width:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        low = np.minimum(low[:size], low[width - done : width - done + size])
        return (_PLACE - (low & _PLACE)).astype(np.int64), self.text[:size] == self.text[span - 1 : size + span - 1], h

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are the last minimum of some window, and their hashes."""
        place, whole, h = self.anchors(K, SPAN)
        at = np.unique(place[whole])
        return at, h[at]

    def fingerprints(self, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes of the winnowed K-grams (size 0) and of all runs of `sizes` words (short items)."""
        at, h = self.winnowed()
        out = [(at, h, np.zeros(len(at), dtype=np.int64))]
        for n in sizes:
            h, whole = self.grams(n)
            at = np.flatnonzero(whole)
            out.append((at, _mix(h[at] + np.uint64(n)), np.full(len(at), n)))
        return tuple(map(np.concatenate, zip(*out)))

    def digests(self, at: np.ndarray, n: int) -> list[bytes]:
        """128-bit digests of the n words from each position, joined by spaces."""
        said, start, end = self.data, self.start, self.end
        words = {}

        def word(i: int) -> bytes:
            if i not in words:
                words[i] = said[start[i] : end[i]].tobytes()
            return words[i]

        return [xxhash.xxh3_128_digest(b" ".join([word(i) for i in range(p, p + n)])) for p in at.tolist()]


def _bit(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a table of so many words for each fingerprint."""
    return (h >> np.uint64(6)) % np.uint64(words), h & np.uint64(63)


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The benchmark's fingerprints (fp, size: words of a short item, else 0), its windows (window, text digest), and items (digest, item)."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = cut(rows.select(F.md5("text").alias("th"), "text").groupBy("th").agg(F.any_value("text").alias("text")))

    def marks(batches):
        for b in slices(batches):
            for part in chunks_of(b.column("text").to_pylist(), 1 << 19):
                words = Words(part)
                sizes = np.diff(words.bound)
                _, fp = words.winnowed()
                yield pa.record_batch([pa.array(fp.view(np.int64)), pa.array(np.zeros(len(fp), dtype=np.int32))], names=["fp", "size"])
                for n in range(1, SPAN):
                    if len(which := np.flatnonzero(sizes == n)):
                        h = _mix(words.grams(n)[0][words.bound[which]] + np.uint64(n))
                        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, dtype=np.int32))], names=["fp", "size"])

    def windows(batches):
        for b in slices(batches):
            for th, text in zip(b.column("th").to_pylist(), b.column("text").to_pylist()):
                words = Words([text])
                n = min(SPAN, len(words.hash))
                said = list(dict.fromkeys(words.digests(np.arange(len(words.hash) - n + 1), n))) if n else []
                yield pa.record_batch([pa.array([th] * len(said), pa.string()), pa.array(said, pa.binary())], names=["th", "window"])

    known = cut(texts.mapInArrow(marks, "fp long, size int").distinct())
    items = rows.select("item", F.md5("text").alias("th")).distinct()
    return known, cut(texts.mapInArrow(windows, "th string, window binary").select("window", F.col("th").alias("said"))), items.select(F.col("th").alias("said"), "item")


def _table(known: DataFrame) -> np.ndarray:
    """The bit table of fingerprints: at most TABLE rows come to the driver."""
    h = F.col("fp")
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(TABLE))
    rows = known.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(TABLE, dtype=np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _judged(frame: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of frame (id, th, text): a written table (id, th, n_words), and the hits (th, n_hit, items, contaminated) of texts that have some."""
    spark = frame.sparkSession
    known, windows, items = _benchmark(benchmark, item_col, item_text_col)
    sizes = sorted(r.size for r in known.where("size > 0").select("size").distinct().collect())
    table = spark.sparkContext.broadcast(_table(known))

    def marks(batches):
        bits = table.value
        for b in slices(batches):
            done = 0
            for part in chunks_of(b.column("text").to_pylist(), 1 << 19):
                words = Words(part)
                at, fp, _ = words.fingerprints(sizes)
                word, bit = _bit(fp, len(bits))
                hit = np.flatnonzero(bits[word] >> bit & np.uint64(1))
                text = words.text[at[hit]]
                order = np.lexsort((fp[hit], text))
                text, fp = text[order], fp[hit][order]
                new = np.ones(len(fp), dtype=bool)
                new[1:] = (fp[1:] != fp[:-1]) | (text[1:] != text[:-1])
                text, fp = text[new], fp[new]
                found = pa.ListArray.from_arrays(np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32), pa.array(fp.view(np.int64)))
                # only texts with such fingerprints are written with the row
                said = pa.array([t if n else None for t, n in zip(part, np.diff(found.offsets.to_numpy()))], pa.string())
                here = b.slice(done, len(part))
                done += len(part)
                yield pa.record_batch([here.column("id"), here.column("th"), pa.array(np.diff(words.bound), pa.int64()), said, found], names=["id", "th", "n_words", "text", "fps"])

    kind = frame.schema["id"].dataType.simpleString()
    marked = cut(frame.mapInArrow(marks, f"id {kind}, th string, n_words long, text string, fps array<long>"))
    # one row for each text with a fingerprint that may be the benchmark's
    some = cut(marked.where("text is not null").groupBy("th").agg(F.any_value("text").alias("text"), F.any_value("fps").alias("fps"), F.any_value("n_words").alias("n_words")))
    met = some.select("th", F.explode("fps").alias("fp")).join(known.select("fp").distinct(), "fp").groupBy("th").agg(F.collect_list("fp").alias("met"))
    near = some.select("th", "text").join(met, "th")

    def extended(batches):
        for b in slices(batches):
            for th, text, hits in zip(b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("met").to_pylist()):
                words = Words([text])
                at, fp, size = words.fingerprints(sizes)
                here = np.isin(fp, np.array(hits, dtype=np.int64).view(np.uint64))
                plans = [(n, at[here & (size == n)]) for n in sizes]
                if (whole := len(words.hash) - SPAN + 1) > 0:  # all windows that hold a hit K-gram
                    spots, held = at[here & (size == 0)], np.zeros(whole + 1, dtype=np.int64)
                    np.add.at(held, np.clip(spots - SPAN + K, 0, whole), 1)
                    np.add.at(held, np.clip(spots + 1, 0, whole), -1)
                    plans.append((SPAN, np.flatnonzero(np.cumsum(held)[:-1] > 0)))
                for n, where in plans:
                    for i in range(0, len(where), 1 << 14):
                        part = where[i : i + (1 << 14)]
                        yield pa.record_batch([pa.array([th] * len(part), pa.string()), pa.array(words.digests(part, n), pa.binary()), pa.array(part, pa.int64()), pa.array(np.full(len(part), n), pa.int32())], names=["th", "window", "at", "n"])

    spots = cut(near.select("th", "text", "met").mapInArrow(extended, "th string, window binary, at long, n int"))
    # written first: a join over an aggregation's own exchange could not be split where one window is common
    shared = cut(windows.select("window").distinct())
    hit = spots.join(shared, "window").groupBy("th").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct((a["total"] + F.greatest(s["at"] + s["n"] - F.greatest(s["at"], a["end"]), F.lit(0))).alias("total"), F.greatest(a["end"], s["at"] + s["n"]).alias("end")), lambda a: a["total"])
    named = spots.select("th", "window").distinct().join(windows, "window").select("th", "said").distinct().join(items, "said")
    named = named.groupBy("th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = hit.select("th", covered.alias("n_hit")).join(named, "th").join(some.select("th", "n_words"), "th")
    return marked, cut(out.select("th", "n_hit", "items", (F.col("n_hit") * 20 >= F.col("n_words")).alias("contaminated")))


def _keyed(docs: DataFrame, id_: Column, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(id_.alias("id"), F.md5(text).alias("th"), text.alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), n_items, contaminated.

    A document is contaminated if it has hits and at least a twentieth of its words are hit.
    """
    marked, hits = _judged(_keyed(docs, F.col(id_col), text_col), benchmark, item_col, item_text_col)
    out = marked.select("id", "th", "n_words").join(hits, "th", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), F.size(items).cast("long").alias("n_items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    _, hits = _judged(_keyed(docs, F.lit(0), text_col), benchmark, item_col, item_text_col)
    name = "_bad"
    while name in docs.columns:
        name = "_" + name
    bad = cut(hits.where("contaminated").select(F.col("th").alias(name)))
    return docs.join(bad, F.md5(F.col(text_col).cast("string")) == F.col(name), "left_anti")
