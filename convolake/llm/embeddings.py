"""Embedding near-dedup by randomised-rotation binary codes.

Distinct vectors are rotated at random, once. Stored of each are: the signs of the first rotations (its
code, CODE_BITS or more), their correction factors (how well a code points along the vector), the vector
in steps of four bits, and the keys of its bands. The inner product of a rotated stepped vector with
another's code, over that one's factor, is an unbiased estimate of their cosine.

1. Buckets: vectors meet where all bits of a band agree, as many bands as find a pair at the threshold
   with probability FOUND. Only codes travel there. A vector stays in a bucket where the upper confidence
   bound of some pair reaches the threshold, and where that pair has not met in an earlier band that the code shows.
2. Vectors are fetched for the rows that stay, and their pairs are computed exactly; only those at the
   threshold or above link. No pair is written out: buckets give sums of links and spanning forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of other dimensions never meet; equal vectors link (a copy is counted
by multiplicity, copies are not compared); repeated ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .simhash import local_forest, runs

#: Chance to meet for a pair at the threshold; rows of a tile; standard deviations of the confidence bound; least bits of a code.
FOUND, TILE, SIGMAS, CODE_BITS = 0.99, 1024, 4.0, 128
#: Most bits of a band: beyond some 10^5 vectors buckets grow instead of the number of bands, and with it what travels.
BAND_BITS = 16


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """count random orthogonal matrices side by side, dim x (count * dim)."""
    rng = np.random.default_rng(7 + dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def bands(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, number of bands) for n distinct vectors."""
    bits = min(BAND_BITS, max(8, math.ceil(math.log2(max(n, 2))) - 2))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - alike))


def encode(x: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: rotated rows, their signs, and the correction factor of each rotation."""
    n, dim = x.shape
    turns = -(-bits * count // dim)
    rotated = x @ rotations(dim, turns)
    signs = np.where(rotated > 0, 1.0, -1.0)
    factor = np.abs(rotated).reshape(n, turns, dim).sum(axis=2) / math.sqrt(dim)
    return rotated, signs, factor


def band_keys(signs: np.ndarray, bits: int, count: int) -> np.ndarray:
    on = (signs[:, : bits * count] > 0).reshape(len(signs), count, bits)
    return (on * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)


def upper_bounds(rotated: np.ndarray, signs: np.ndarray, factor: np.ndarray, dim: int, step: np.ndarray | float = 0.0) -> np.ndarray:
    """Upper confidence bounds of the cosines of paired rows: queries as rotated, partners as signs and factors.

    The estimate of one rotation has variance (1 - f^2) / f^2 / (dim - 1) at most, and step^2 / 4 / f^2 where
    the query was rounded to whole steps; rotations are averaged.
    """
    n, turns = factor.shape
    each = (rotated * signs).reshape(n, turns, dim).sum(axis=2) / math.sqrt(dim) / factor
    return each.mean(axis=1) + _margin(factor, dim, np.asarray(step, dtype=np.float64)[..., None])


def _margin(factor: np.ndarray, dim: int, step: np.ndarray) -> np.ndarray:
    spread = np.maximum(1 - factor**2, 0) / max(dim - 1, 1) + step**2 / 4
    return SIGMAS * np.sqrt((spread / factor**2).sum(axis=-1)) / factor.shape[-1]


def stored(x: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows: bytes of code, factors and stepped vector; and the keys of the bands."""
    n, dim = x.shape
    turns = -(-CODE_BITS // dim)
    _, signs, factor = encode(x, 1, max(bits * count, dim * turns))
    step = np.abs(x).max(axis=1, keepdims=True) / 7
    steps = np.zeros((n, dim + dim % 2), dtype=np.uint8)
    steps[:, :dim] = np.rint(x / step) + 8
    parts = [np.packbits(signs[:, : dim * turns] > 0, axis=1), factor[:, :turns].astype("<f4").view(np.uint8), step.astype("<f4").view(np.uint8), steps[:, ::2] << 4 | steps[:, 1::2]]
    return np.concatenate(parts, axis=1), band_keys(signs, bits, count)


def restored(said: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What stored() wrote: rotated stepped vectors, signs, factors, steps."""
    n, turns = len(said), -(-CODE_BITS // dim)
    code, factor, step, steps = np.split(said, np.cumsum([-(-dim * turns // 8), 4 * turns, 4]), axis=1)
    signs = np.unpackbits(code, axis=1)[:, : dim * turns].astype(np.float32) * 2 - 1
    factor, step = (np.ascontiguousarray(y).view("<f4").astype(np.float64) for y in (factor, step))
    x = (np.stack([steps >> 4, steps & 15], axis=2).reshape(n, -1)[:, :dim].astype(np.float64) - 8) * step
    return (x @ rotations(dim, turns)).astype(np.float32), signs, factor, step[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision and safe for huge and tiny components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(mine, at, apart):
    """Pairs (a, b, run) of rows inside runs, in parts; of runs that are apart only those of different `mine`.

    Small runs go side by side, large ones in blocks of rows: no more than some 2^17 pairs are held.
    """
    sizes = np.diff(at)
    small = np.flatnonzero(sizes <= 32)
    for d in range(1, int(sizes[small].max(initial=1))):
        some = small[sizes[small] > d]
        run = np.repeat(some, sizes[some] - d)
        lead = np.concatenate([np.arange(s, e - d) for s, e in zip(at[some], at[some + 1])] or [np.zeros(0, dtype=np.int64)])
        ok = ~apart[run] | (mine[lead] != mine[lead + d])
        lead, run = lead[ok], run[ok]
        for i in range(0, len(lead), 1 << 14):
            yield lead[i : i + (1 << 14)], lead[i : i + (1 << 14)] + d, run[i : i + (1 << 14)]
    for r in np.flatnonzero(sizes > 32):
        s, e = at[r], at[r + 1]
        for i in range(s, e, 64):
            a, b = np.triu_indices(min(64, e - i), 1, e - i)
            if apart[r]:
                ok = mine[a + i] != mine[b + i]
                a, b = a[ok], b[ok]
            yield a + i, b + i, np.full(len(a), r)


def _met(keys, a, b, which):
    """Pairs with an equal key in a band before the one that they are looked at in."""
    return ((keys[a] == keys[b]) & (np.arange(keys.shape[1]) < which[:, None])).any(axis=1)


def _staying(said, dim, mine, band, bits, count, at, apart, threshold):
    """Rows in whose run some pair's bound reaches the threshold, not met in an earlier band of the code."""
    rotated, signs, factor, step = restored(said, dim)
    keys = band_keys(signs, bits, min(count, signs.shape[1] // bits))
    stay = np.zeros(len(said), dtype=bool)
    for a, b, run in _pairs(mine, at, apart):
        # pairs of rows that stay already decide nothing
        open_ = ~(stay[a] & stay[b])
        a, b, run = a[open_], b[open_], run[open_]
        for i in range(0, len(a), 1 << 14):
            u, v, w = a[i : i + (1 << 14)], b[i : i + (1 << 14)], band[run[i : i + (1 << 14)]]
            near = upper_bounds(rotated[u], signs[v], factor[v], dim, step[u]) >= threshold
            u, v, w = u[near], v[near], w[near]
            new = ~_met(keys, u, v, w)
            stay[u[new]] = stay[v[new]] = True
    return stay


def _links_in(x, keys, times, mine, band, at, apart, threshold):
    """Links inside runs of rows (band[i] is the band of run i): summed multiplicities, and spanning (a, b) rows."""
    total, pairs, held = np.zeros(len(x), dtype=np.int64), [], 0
    for a, b, run in _pairs(mine, at, apart):
        for i in range(0, len(a), 1 << 14):
            u, v = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            exact = np.flatnonzero((x[u] * x[v]).sum(axis=1) >= threshold)
            # a pair that met in an earlier band was counted there
            exact = exact[~_met(keys, u[exact], v[exact], band[run[i + exact]])]
            u, v = u[exact], v[exact]
            np.add.at(total, u, times[v])
            np.add.at(total, v, times[u])
            pairs.append((u, v))
            held += len(u)
        if held > 1 << 20:
            label = local_forest(len(x), pairs)
            own = np.flatnonzero(label != np.arange(len(x)))
            pairs, held = [(own, label[own])], 0
    label = local_forest(len(x), pairs)
    own = np.flatnonzero(label != np.arange(len(x)))
    return total, own, label[own]


def _keyed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key): a digest of the vector's bytes, null for vectors that link with nothing; and the vector."""
    v = F.col("v")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    said = F.sha2(F.to_json("v").cast("binary"), 256)
    return rows.withColumn("key", F.when(F.coalesce(good, F.lit(False)), said))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable, its own included), kept."""
    spark = vectors.sparkSession
    rows = _keyed(vectors, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    keys = cut(rows.select("id", "key"))
    distinct = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.any_value("v").alias("v"))
    # written before it is used: the numbers are given once
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()), F.count("*").alias("n"))
    bits, count = bands(distinct.saw["n"], threshold)

    def coded(batches):
        for b in batches:
            dims = np.array([len(v) for v in b.column("v")], dtype=np.int64)
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                said, keys = stored(unit(part.column("v").flatten().to_numpy().reshape(len(part), dim)), bits, count)
                # the band's number and the dimension belong to the bucket
                full = keys | (np.arange(count) << 24) | (np.int64(dim) << 36)
                yield pa.record_batch([part.column("node"), pa.array([r.tobytes() for r in said], pa.binary()), pa.array(list(full), pa.list_(pa.int64()))], names=["node", "said", "buckets"])

    codes = cut(distinct.where("rep is not null").select("node", "v").mapInArrow(coded, "node long, said binary, buckets array<long>"))
    # only buckets that take more than one tile: most often a small table, which Spark then broadcasts by its size
    large = cut(codes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > TILE))
    chunks = F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int")
    met = codes.select("node", "said", F.explode("buckets").alias("bucket")).join(large, "bucket", "left")
    met = met.withColumn("mine", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "said")

    def by_dim(c, at):
        """Of each dimension in the runs: it, its rows, their bounds, and the first row of each run."""
        dims = c["bucket"][at[:-1]] >> 36
        for dim in np.unique(dims):
            some = dims == dim
            pick = np.concatenate([np.arange(s, e) for s, e in zip(at[:-1][some], at[1:][some])])
            yield int(dim), pick, np.concatenate(([0], np.cumsum(np.diff(at)[some]))), at[:-1][some]

    tile = ["bucket", "i", "j"]

    def near(batches):
        for c, at in runs(batches, [*tile, "mine", "node", "said"], tile, 4096):
            for dim, pick, own, head in by_dim(c, at):
                said = np.frombuffer(b"".join(c["said"][pick]), dtype=np.uint8).reshape(len(pick), -1)
                rows = pick[_staying(said, dim, c["mine"][pick], (c["bucket"][head] >> 24) & 0xFFF, bits, count, own, c["i"][head] != c["j"][head], threshold)]
                yield pa.record_batch([pa.array(c[name][rows]) for name in (*tile, "mine", "node")], names=[*tile, "mine", "node"])

    stay = cut(met.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(near, "bucket long, i int, j int, mine int, node long"))
    full = distinct.select("node", "rep", "times", "v").join(codes.select("node", "buckets"), "node")
    full = stay.join(full, "node").repartition(*tile).sortWithinPartitions(*tile)

    def linked(batches):
        for c, at in runs(batches, [*tile, "mine", "node", "rep", "times", "v", "buckets"], tile, 4096):
            for dim, pick, own, head in by_dim(c, at):
                x, met_in, rep = unit(np.stack(c["v"][pick])), np.stack(c["buckets"][pick]), c["rep"][pick]
                total, u, v = _links_in(x, met_in, c["times"][pick], c["mine"][pick], (c["bucket"][head] >> 24) & 0xFFF, own, c["i"][head] != c["j"][head], threshold)
                nodes, where = np.unique(c["node"][pick], return_inverse=True)
                sums = np.zeros(len(nodes), dtype=np.int64)
                np.add.at(sums, where, total)
                some, none = np.flatnonzero(sums), len(u)
                yield pa.record_batch([pa.array([*nodes[some], *[None] * none], pa.int64()), pa.array([*sums[some], *[None] * none], pa.int64()), pa.array([*[None] * len(some), *rep[u]], pa.int64()), pa.array([*[None] * len(some), *rep[v]], pa.int64())], names=["linked", "n", "u", "v"])

    found = cut(full.mapInArrow(linked, "linked long, n long, u long, v long"))
    links = found.where("linked is not null").groupBy("linked").agg(F.sum("n").alias("n"))
    comp = components(found.where("u <> v").select("u", "v"))
    about = distinct.select(F.col("key").alias("_key"), "node", "rep", "times").join(links, F.col("node") == F.col("linked"), "left")
    about = about.join(comp.withColumnRenamed("node", "of"), F.col("rep") == F.col("of"), "left")
    about = about.select("_key", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"))
    out = keys.join(about, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("component", "id").cast(kind)
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
