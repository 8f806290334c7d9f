"""Components of a link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.tables import cut, drop, scratch

__all__ = ["bit_table", "components", "cut", "drop", "in_table", "scratch", "slices"]

#: 64-bit words of a bit table (8 MB), whatever the number of hashes in it.
WORDS = 1 << 20


def slices(batches, rows: int = 256):
    """Arrow batches in parts of few rows: texts can be long, and Python objects of a whole batch take many times its bytes."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of bits for hashes (column h, long): a hash that it lacks is not among them. At most WORDS rows reach the driver."""
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("w")
    rows = hashes.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(WORDS, dtype=np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the table."""
    h = h.view(np.uint64)
    return (table[(h >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (u, v).

    Alternating large-star and small-star rounds; each round is two aggregations with
    map-side partial minima and two joins, so that a hub of many links is never gathered
    in one task. Rounds end when a round leaves the edge set as it was.
    """
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")]
    now = cut(_distinct(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), *mark)
    while now.saw["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        kept = low.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v"))
        big = cut(_distinct(large.unionByName(kept)))
        low = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = big.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(_distinct(small.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))), *mark)
        drop(big)
        drop(now)
        now, last = new, now.saw
        if now.saw == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").distinct()
