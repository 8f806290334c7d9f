"""Importance resampling towards a target distribution, over hashed runs of words.

A text is scanned once: a ring keeps the running CRC-32 states of the runs that began at the last n words.
Each new word extends every state of the ring by a space and itself, and starts a state of its own; the
states of the ring, modulo the number of buckets, are the features that end at this word. No run of words is
ever put together.

1. Tasks count features by bucket, in the corpus and in the target; sums are one row a bucket.
2. A bucket's gain is the logarithm of its smoothed share in the target over that in the corpus.
3. A second scan sums gains a text; with noise drawn from the id the highest scores are a sample without
   replacement whose odds are the weights. Places come from ranges of scores, never from one sorted task.

Defined results: null, empty and wordless texts have no features and weight 0; texts of fewer words than
`least` are weighed but never drawn; a null id is said as an empty text; rows repeated come back as often as
given, each with a place of its own; other columns are ignored. Words of any length and texts of any length
are taken whole, in pieces.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

N, BUCKETS, LEAST, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Bytes of text that are split into words at once.
PIECE = 1 << 20

#: UTF-8 bytes of words: digits, letters in lower case, and everything beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def pieces(raw: bytes):
    """raw in parts of about PIECE bytes that end where no word does."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def scan(text: str | None, n: int = N, buckets: int = BUCKETS):
    """Arrays of the buckets of all runs of 1 to n words, and the number of words of each piece."""
    ring: list[int] = []
    for part in pieces((text or "").encode().lower()):
        words, out = _WORD.findall(part), []
        for w in words:
            said = b" " + w
            ring = [crc32(said, state) for state in ring[1 - n :]] if n > 1 else []
            ring.append(crc32(w))
            out += ring
        yield np.array(out, dtype=np.int64) % buckets, len(words)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sends its sums."""

    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                for part, _ in scan(text, n, buckets):
                    total += np.bincount(part, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(counted, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, corpus: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of every bucket floor(1000 ln(share in target / share in corpus)), each count raised by one.

    What comes to the driver is one row a bucket, whatever the size of the tables.
    """
    t, s = np.zeros(buckets), np.zeros(buckets)
    for side, counts in ((t, target), (s, corpus)):
        for r in counts.collect():
            side[r.bucket] = r.n
    whole_t, whole_s = t.sum() + buckets, s.sum() + buckets
    return np.array([math.floor(1000 * math.log((a + 1) * whole_s / ((b + 1) * whole_t))) for a, b in zip(t.tolist(), s.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """id, n_words, n_features and weight (the sum of the gains of its features) of every row."""

    def weighed(batches):
        for b in slices(batches):
            words, features, weight = [], [], []
            for text in b.column(1).to_pylist():
                w = f = total = 0
                for part, count in scan(text, n, len(gain)):
                    w, f, total = w + count, f + len(part), total + int(gain[part].sum())
                words.append(w), features.append(f), weight.append(total)
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(weighed, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("id", id_col)


def places(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows numbered from 1 in the given order: each range numbers its own and adds the sizes of those before it."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(sorted_)
    part = F.shiftright("_at", 33)
    sizes = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, base = 0, {}
    for p in sorted(sizes):
        base[p], before = before, before + sizes[p]
    if not base:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_at")
    # one row a range
    offsets = dealt.sparkSession.createDataFrame(list(base.items()), "_part long, _before long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, local + F.col("_before")).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (from 1; null where not drawn) of every row.

    Of the rows with at least `least` words `percent` in a hundred are drawn, those of the highest scores, ties by the smaller id.
    """
    gain = gains(bucket_counts(target, text_col, n, buckets), bucket_counts(docs, text_col, n, buckets), buckets)
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(said, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = F.floor(-1000 * F.log(-F.log(chance)))
    scored = weigh(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise)
    fit = F.col("n_words") >= least
    scored = cut(scored, F.count("*").alias("all"), F.count(F.when(fit, 1)).alias("fit"))
    draw = percent * scored.saw["fit"] // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("weight"), F.asc("n_features")]
    ranked = places(scored.where(fit), order, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id was drawn, all their columns."""
    ids = ranked.where("rank is not null").select(F.col(id_col).alias("_id")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
