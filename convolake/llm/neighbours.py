"""Nearest neighbours by inner product, by cross-polytope hashing.

A unit vector is turned by fast Hadamard transforms with random signs and belongs to the signed axis it lies
nearest to; several turned copies, the last with fewer axes, make the bucket of a table. A query looks into the buckets
of each table in the order of how little its own axes would have to give way for them.

1. Distinct vectors are indexed, all of them; copies are counted by their smallest ids, which is exact.
2. Number of axes, tables and probes are fitted: of at most SAMPLE queries the true neighbours are found by one
   scan, and the cheapest choice that has TARGET of them in the probed buckets is taken.
3. Candidates and queries of a bucket meet in tiles of at most TILE rows of either. Tasks keep the k + 1 best of each
   query, over all their tiles, by the exact inner product of the original vectors, in double precision.
4. Queries that found fewer than there are (few tables, rare buckets) are searched again by a scan, in blocks.

Vectors of about one length (within 2^(1/8)) share buckets, others don't, and queries look into all lengths: a bucket
is about directions, the order of the result about inner products.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take
no part; vectors of other dimensions never meet; every row is a candidate for every query but its own, also rows alike
or of the same id; ties go to the smaller id; fewer than k candidates are all returned; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .embeddings import unit
from .simhash import runs

K, TILE = 20, 4096
#: Queries of the fit; share of their neighbours to be found; most probes of a table; choices of the number of tables.
SAMPLE, TARGET, PROBES, TABLES = 64, 0.97, 256, (1, 2, 4, 8, 16)
#: Vectors up to which all meet in one bucket; queries of one scan; the cost of a shuffled row in inner products.
FEW, BLOCK, ROW_COST = 1024, 2048, 150
#: Found rows that a task holds.
HELD = 1 << 20


def hadamard(y: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows whose length is a power of two."""
    n, size = y.shape
    half = 1
    while half < size:
        y = y.reshape(n, -1, 2, half)
        y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, size)
        half *= 2
    return y / math.sqrt(size)


def axes(bits: int, dim: int) -> list[int]:
    """How many coordinates of each turned copy take part, for 2^bits buckets of a table."""
    full = 1 + max(1, math.ceil(math.log2(max(dim, 2))))
    return [1 << (full - 1)] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])


def nearness(x: np.ndarray, table: int, part: int, coords: int) -> np.ndarray:
    """Of unit rows the turned coordinates and their negatives: the nearest signed axis has the largest."""
    size = 1 << max(1, math.ceil(math.log2(max(x.shape[1], 2))))
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for signs in np.random.default_rng([table, part, size]).choice([-1.0, 1.0], (3, size)):
        y = hadamard(y * signs)
    return np.concatenate([y[:, :coords], -y[:, :coords]], axis=1)


def buckets(x: np.ndarray, bits: int, table: int) -> np.ndarray:
    code = np.zeros(len(x), dtype=np.int64)
    for part, coords in enumerate(axes(bits, x.shape[1])):
        code = code * 2 * coords + nearness(x, table, part, coords).argmax(axis=1)
    return code


def probes(x: np.ndarray, bits: int, table: int, count: int) -> np.ndarray:
    """The first `count` buckets (all, if fewer) by the squared ways that axes give way, summed; the own one first."""
    cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
    for part, coords in enumerate(axes(bits, x.shape[1])):
        near = nearness(x, table, part, coords)
        way = (near.max(axis=1, keepdims=True) - near) ** 2
        cost = (cost[:, :, None] + way[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * way.shape[1] + np.arange(way.shape[1])).reshape(len(x), -1)
        if cost.shape[1] > count:
            pick = np.argpartition(cost, count - 1, axis=1)[:, :count]
            cost, code = np.take_along_axis(cost, pick, axis=1), np.take_along_axis(code, pick, axis=1)
    return np.take_along_axis(code, cost.argsort(axis=1, kind="stable"), axis=1)


def choose(queries: np.ndarray, true: list[np.ndarray], n: int, wanted: int) -> tuple[int, int, int]:
    """(bits, tables, probes) of the least cost that has TARGET of the true neighbours in probed buckets.

    queries: unit rows; true: of each query its neighbours, as unit rows. One bucket for all where nothing else does.
    """
    whole = (0, 1, 1)
    if n <= FEW or not sum(map(len, true)):
        return whole
    who, near = np.repeat(np.arange(len(true)), [len(t) for t in true]), np.concatenate([t for t in true if len(t)])
    best, least = whole, math.inf
    for bits in range(min(40, int(math.log2(n / 32))), 3, -2):
        place = np.full(len(near), PROBES)
        for table in range(TABLES[-1]):
            looked = probes(queries, bits, table, PROBES)[who] == buckets(near, bits, table)[:, None]
            place = np.minimum(place, np.where(looked.any(axis=1), looked.argmax(axis=1), PROBES))
            tables = table + 1
            count = int(np.sort(place)[math.ceil(TARGET * len(place)) - 1]) + 1
            if tables in TABLES and count <= PROBES:
                cost = tables * (ROW_COST * (n + count * wanted) + n * wanted * count / 2**bits)
                if cost < least:
                    best, least = (bits, tables, count), cost
    return best


def best_of(q: np.ndarray, x: np.ndarray, rep: np.ndarray, k: int):
    """(query, row, inner product) of the k best rows of x for each row of q; ties by rep."""
    long = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
    for i in range(0, len(q), 256):
        some = q[i : i + 256]
        rough = some @ x.T
        if len(x) > k:
            slack = 1e-12 * (1 + np.sqrt((some * some).sum(axis=1)) * long)
            enough = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - slack
            a, b = np.nonzero(rough >= enough[:, None])
        else:
            a, b = (m.ravel() for m in np.indices(rough.shape))
        score = (some[a] * x[b]).sum(axis=1)
        order = np.lexsort((rep[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        yield i + a[place < k], b[place < k], score[place < k]


_FOUND = "query long, node long, rep {id}, times int, score double"


def _found(query, node, rep, times, score):
    return pa.record_batch([pa.array(query), pa.array(node), pa.array(rep), pa.array(times, pa.int32()), pa.array(score)], names=["query", "node", "rep", "times", "score"])


class _Best:
    """Each query's k best rows of what a task found so far, whatever tiles they came from."""

    def __init__(self, k: int):
        self.k, self.held, self.rows = k, [], 0

    def add(self, *found):
        """Takes columns of _FOUND; gives batches only where the queries of the task are too many to be held."""
        self.held.append(found)
        self.rows += len(found[0])
        if self.rows > HELD:
            self._merge()
            if self.rows > HELD // 2:
                yield from self.rest()

    def _merge(self):
        query, node, rep, times, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((node, rep, -score, query))
        query, node = query[order], node[order]
        # a pair that was found in several tables has the same place in all
        new = np.concatenate(([True], (query[1:] != query[:-1]) | (node[1:] != node[:-1])))
        order, query = order[new], query[new]
        keep = order[np.arange(len(query)) - np.searchsorted(query, query) < self.k]
        self.held = [tuple(np.concatenate(x)[keep] for x in zip(*self.held))]
        self.rows = len(keep)

    def rest(self):
        if self.rows:
            self._merge()
            yield _found(*self.held[0])
        self.held, self.rows = [], 0


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scan(distinct: DataFrame, queries: list, k: int) -> DataFrame:
    """The k best of all distinct vectors for a block of queries (node, v), compared with each; every task sends its own best."""
    nodes, q = np.array([r.node for r in queries], dtype=np.int64), np.array([r.v for r in queries], dtype=np.float64)

    def scanned(batches):
        best = _Best(k)
        for b in batches:
            if not b.num_rows:
                continue
            for i in range(0, b.num_rows, TILE):
                part = b.slice(i, TILE)
                node, rep, times = (part.column(c).to_numpy() for c in ("node", "rep", "times"))
                for a, r, score in best_of(q, _matrix(part.column("v")), rep, k):
                    yield from best.add(nodes[a], node[r], rep[r], times[r], score)
        yield from best.rest()

    rows = distinct.select("node", "rep", "times", "v")
    return _top(rows.mapInArrow(scanned, _FOUND.format(id=rows.schema["rep"].dataType.simpleString())), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best nodes. A pair that was found in several tables is one: its inner product is the same in all."""
    one = found.repartition("query").groupBy("query", "node").agg(F.first("rep").alias("rep"), F.first("times").alias("times"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep", "node"))
    return one.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _meet(distinct: DataFrame, bits: int, tables: int, count: int, lengths: list[int], k: int) -> DataFrame:
    """Each query's k best nodes of those that it meets in a probed bucket."""

    def coded(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, ask = unit(_matrix(b.column("v"))), b.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
            band = b.column("band").to_numpy().astype(np.int64)
            mark = lambda code, table, length: code | (np.int64(table) << 41) | ((length + 4096) << 46)
            own = np.stack([mark(buckets(x, bits, t), t, band) for t in range(tables)], axis=1)
            looked = np.concatenate([mark(probes(x[ask], bits, t, count), t, np.int64(n)) for t in range(tables) for n in lengths], axis=1)
            asked = iter(looked)
            yield pa.record_batch([b.column("node"), pa.array(list(own), pa.list_(pa.int64())), pa.array([next(asked) if a else None for a in ask], pa.list_(pa.int64()))], names=["node", "own", "looked"])

    codes = cut(distinct.select("node", "v", "wanted", "band").mapInArrow(coded, "node long, own array<long>, looked array<long>"))
    rows = distinct.select("node", "rep", "times", "v").join(codes, "node")
    side = lambda column, n: codes.select(F.explode(column).alias("bucket"), F.lit(1 - n).alias("c"), F.lit(n).alias("q"))
    sizes = side("own", 0).unionByName(side("looked", 1)).groupBy("bucket").agg(F.sum("c").alias("c"), F.sum("q").alias("q"))
    # only buckets that take more than one tile: most often a small table, which Spark then broadcasts by its size
    large = cut(sizes.where((F.col("c") > TILE) | (F.col("q") > TILE)))
    chunks = {s: F.coalesce(F.ceil(F.col(s) / TILE).cast("int"), F.lit(1)) for s in "cq"}

    def dealt(column, n):
        mine, other = ("c", "q") if n == 0 else ("q", "c")
        out = rows.select("node", "rep", "times", "v", F.explode(column).alias("bucket"), F.lit(n).alias("side")).join(large, "bucket", "left")
        out = out.withColumn("_" + mine, F.pmod(F.xxhash64("node"), F.greatest(chunks[mine], F.lit(1))).cast("int"))
        out = out.withColumn("_" + other, F.explode(F.sequence(F.lit(0), F.greatest(chunks[other], F.lit(1)) - 1)))
        return out.select("bucket", F.col("_c").alias("i"), F.col("_q").alias("j"), "side", "node", "rep", "times", "v")

    tile = ["bucket", "i", "j"]

    def scored(batches):
        best = _Best(k)
        for c, at in runs(batches, [*tile, "side", "node", "rep", "times", "v"], tile, 4096):
            for s, e in zip(at, at[1:]):
                asks = c["side"][s:e] == 1
                cand, ask = s + np.flatnonzero(~asks), s + np.flatnonzero(asks)
                if not len(cand) or not len(ask):
                    continue
                x, q = (np.stack(c["v"][r]).astype(np.float64) for r in (cand, ask))
                for a, r, score in best_of(q, x, c["rep"][cand], k):
                    yield from best.add(c["node"][ask[a]], c["node"][cand[r]], c["rep"][cand[r]], c["times"][cand[r]], score)
        yield from best.rest()

    met = dealt("own", 0).unionByName(dealt("looked", 1)).repartition(*tile).sortWithinPartitions(*tile)
    return _top(met.mapInArrow(scored, _FOUND.format(id=distinct.schema["rep"].dataType.simpleString())), k)


def _searched(distinct: DataFrame, k: int) -> DataFrame:
    """Of vectors of one dimension, each query's k best nodes (all that hold the k best rows)."""
    spark = distinct.sparkSession
    n, wanted, rows = distinct.agg(F.count("*"), F.count(F.when(F.col("wanted"), 1)), F.sum("times")).first()
    if not wanted:
        return spark.createDataFrame([], _FOUND.format(id=distinct.schema["rep"].dataType.simpleString()))
    lengths = sorted(r.band for r in distinct.select("band").distinct().collect())
    asks = distinct.where("wanted").orderBy(F.xxhash64("node")).limit(SAMPLE).select("node", "v").collect() if n > FEW else []
    sample, true = [], []
    if asks:
        best = scan(distinct, asks, k).join(distinct.select("node", "v"), "node").where("query <> node").select("query", "v").collect()
        sample = unit(np.array([r.v for r in asks], dtype=np.float64))
        by = {r.node: [] for r in asks}
        for r in best:
            by[r.query].append(r.v)
        true = [unit(np.array(by[r.node], dtype=np.float64)) if by[r.node] else np.zeros((0, sample.shape[1])) for r in asks]
    bits, tables, count = choose(sample, true, n, wanted)
    met = cut(_meet(distinct, bits, tables, count, lengths, k))
    full = met.groupBy("query").agg(F.sum("times").alias("n")).where(F.col("n") >= min(k, rows)).select(F.col("query").alias("_q"))
    left = cut(distinct.where("wanted").join(full, F.col("node") == F.col("_q"), "left_anti").select("node", "v"), F.count("*").alias("n"))
    if not left.saw["n"]:
        return met
    out = met.join(full, F.col("query") == F.col("_q"), "left_semi")
    blocks = -(-left.saw["n"] // BLOCK)
    for i in range(blocks):
        # a block has about BLOCK queries, whatever their number
        out = out.unionByName(cut(scan(distinct, left.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i).collect(), k)))
    return out


def nearest(vectors: DataFrame, asked: Column | str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), id and score of the k nearest found of each row for which `asked` holds."""
    v, keep = F.col("v"), k + 1
    good = (F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.coalesce(F.expr(asked) if isinstance(asked, str) else asked, F.lit(False)).alias("wanted")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    # -0 and 0 are one: their inner products are
    digest = F.sha2(F.to_json(F.transform(v, lambda x: x + F.lit(0).cast("float"))).cast("binary"), 256)
    rows = rows.withColumn("key", digest)
    keys = cut(rows.select("id", "key", "wanted"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    band = F.greatest(F.least(F.round(F.coalesce(F.log2(F.sqrt(square)), F.lit(-1e9)) * 4), F.lit(4095.0)), F.lit(-4095.0)).cast("int")
    alike = rows.groupBy("key").agg(F.any_value("v").alias("v"), F.min("id").alias("rep"), F.least(F.count("*"), F.lit(keep)).cast("int").alias("times"), F.max("wanted").alias("wanted"))
    alike = alike.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")).withColumn("band", band)
    distinct = cut(alike)
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    copies = keys.join(distinct.where("times > 1").select("key", "node"), "key").withColumn("_first", first).where(F.col("_first") <= keep)
    copies = copies.groupBy("node").agg(F.collect_list("id").alias("ids"))
    best = None
    for r in distinct.select("dim").distinct().orderBy("dim").collect():
        found = _searched(distinct.where(F.col("dim") == r.dim), keep)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = vectors.sparkSession.createDataFrame([], _FOUND.format(id=distinct.schema["rep"].dataType.simpleString()))
    best = cut(best)
    each = best.join(copies, "node", "left").withColumn("id", F.explode(F.coalesce("ids", F.array("rep"))))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    each = each.withColumn("place", place).where(F.col("place") <= keep)
    lists = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", (F.col("query") == F.col("node")).alias("own")))).alias("found"))
    lists = cut(lists.join(distinct.select("node", "key"), F.col("query") == F.col("node")).select("key", "found"))
    # a row's own entry among the k + 1 is left out; where it isn't among them the last is
    asks = keys.where("wanted").join(lists, "key")
    own = F.array_position(F.transform("found", lambda x: x["own"] & (x["id"] == F.col("id"))), True)
    others = F.filter("found", lambda x, i: i + 1 != F.col("_own"))
    out = asks.withColumn("_own", own).withColumn("found", F.slice(others, 1, k))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("found").alias("_pos", "_one"))
    return out.select("query_id", (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_one.id").alias(id_col), F.col("_one.score").alias("score"))
