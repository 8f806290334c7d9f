"""Ranked keyword, semantic and fused search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.functions import vectors as V

#: Reciprocal-rank fusion's constant.
RRF = 60


def keyword(rows: DataFrame, query: str, text_col: str = "text", limit: int = 50, offset: int = 0, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows that match, best first; the page is a top-k, so no full sort of the corpus."""
    q = T.parse_query(query)
    toks = T.tokens(F.col(text_col))
    hit = rows.where(T.matches(toks, q)).withColumn("rank", T.rank(toks, q))
    return hit.orderBy(F.desc("rank"), *[F.desc(c) for c in order]).offset(offset).limit(limit)


def postings(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Inverted index (token, id, tf, length), to be written bucketed by token where it is used often."""
    # the length is known before the words are dealt out: beside them each word's row would split its whole text again
    texts = rows.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("toks")).select("id", F.size("toks").alias("length"), "toks")
    each = texts.select("id", "length", F.explode("toks").alias("token"))
    return each.groupBy("token", "id", "length").agg(F.count("*").alias("tf"))


def by_postings(index: DataFrame, words: list[str], limit: int = 50) -> DataFrame:
    """Rows that hold all words, ranked as keyword() does, from the index alone."""
    hit = index.where(F.col("token").isin(words)).groupBy("id", "length").agg(F.sum("tf").alias("tf"), F.count("*").alias("words"))
    ranked = hit.where(F.col("words") == len(set(words))).select("id", F.round(F.col("tf") / (1 + F.log(1.0 + F.col("length"))), 6).alias("rank"))
    return ranked.orderBy(F.desc("rank"), F.desc("id")).limit(limit)


def cosines(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine of every vector with the one-row query(q), which is normalised once; null where a vector has no direction."""
    q = F.broadcast(query.limit(1).select(V.normalize(F.col("q")).alias("q")))
    length = F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))
    sim = F.when(length > 0, V.dot(F.col("embedding"), F.col("q")) / length)
    return vectors.crossJoin(q).select("id", F.round(sim, 6).alias("similarity")).where("similarity is not null")


def semantic(vectors: DataFrame, query: DataFrame, limit: int = 50, threshold: float | None = None) -> DataFrame:
    """Vectors by cosine with the one-row query(q); of equal ones the higher id first."""
    rows = cosines(vectors, query)
    if threshold is not None:
        rows = rows.where(F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), F.desc("id")).limit(limit)


def fuse(first: DataFrame, second: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two bounded ranked lists (id, place)."""
    a, b = (x.select("id", (1.0 / (RRF + F.col("place"))).alias(n)) for x, n in ((first, "a"), (second, "b")))
    both = a.join(b, "id", "full_outer").select("id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9).alias("score"))
    return both.orderBy(F.desc("score"), F.desc("id")).limit(limit)


def placed(ranked: DataFrame, order: list) -> DataFrame:
    """Places 1.. of a bounded ranked list."""
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def search(rows: DataFrame, vectors: DataFrame | None, query: str, query_vector: DataFrame | None, mode: str = "keyword", limit: int = 20) -> tuple[DataFrame, bool]:
    """(hits, degraded): semantic and hybrid fall back to keyword where there are no vectors."""
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    degraded = mode != "keyword" and (vectors is None or query_vector is None)
    if mode == "keyword" or degraded:
        return keyword(rows, query, limit=limit).select("id", F.col("rank").alias("score")), degraded
    near = semantic(vectors, query_vector, limit)
    if mode == "semantic":
        return near.select("id", F.col("similarity").alias("score")), False
    words = placed(keyword(rows, query, limit=limit).select("id", "rank"), [F.desc("rank"), F.desc("id")])
    return fuse(words, placed(near, [F.desc("similarity"), F.desc("id")]), limit), False


def match_positions(rows: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """One row for each occurrence of the query, numbered within its text."""
    n = T.occurrences(F.col(text_col), query)
    return rows.withColumn("n", n).where("n > 0").withColumn("match", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
