"""Full-text ranking by positions, a stored index, and marked fragments of the texts that were found."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.streaming.snapshots import Snapshots

#: Weight of a word, and the farthest that two words are from each other to count.
WEIGHT, FAR = 0.1, 100
#: Folders that a stored index is dealt into by token.
BUCKETS = 64
#: A word and what follows it up to the next one.
PIECE = r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*"


def positions(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Inverted index with places: token, id, length (words of the text), positions (from 0, ascending)."""
    # the length is known before the words are dealt out: beside them each word's row would split its whole text again
    texts = rows.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("toks")).select("id", F.size("toks").alias("length"), "toks")
    each = texts.select("id", "length", F.posexplode("toks").alias("pos", "token"))
    return each.groupBy("token", "id", "length").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def nearness(distance: Column) -> Column:
    """Weight of a pair of words some words apart: about 1 side by side, falling exponentially."""
    return 1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))


def rank(index: DataFrame, words: list[str]) -> DataFrame:
    """id, rank of the texts that hold all the words.

    Several words: 1 - product of (1 - WEIGHT * sqrt(nearness)) over all pairs of places of two different words at
    most FAR apart. One word: WEIGHT * (1 + 1/4 + 1/9 + … + 1/n^2) / (pi^2 / 6) for n places. Places of a pair meet by
    ranges of FAR + 1 words, so that no text's places are all compared with each other.
    """
    words = sorted(set(words))
    hit = index.where(F.col("token").isin(words))
    if len(words) == 1:
        squares = F.aggregate(F.sequence(F.lit(1), F.size("positions")), F.lit(0.0), lambda a, j: a + 1.0 / (j.cast("double") * j))
        return hit.select("id", F.round(WEIGHT * squares / (math.pi**2 / 6), 6).alias("rank"))
    full = hit.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("id")
    each = hit.join(full, "id", "left_semi").select("id", "token", F.explode("positions").alias("pos"))
    part = lambda p: F.floor(p / (FAR + 1))
    left = each.select("id", F.col("token").alias("a"), F.col("pos").alias("p"), part(F.col("pos")).alias("part"))
    right = each.select("id", F.col("token").alias("b"), F.col("pos").alias("q"), F.explode(F.sequence(part(F.col("pos") - FAR), part(F.col("pos") + FAR))).alias("part"))
    apart = F.abs(F.col("p") - F.col("q"))
    pairs = left.join(right, ["id", "part"]).where((F.col("a") < F.col("b")) & (apart <= FAR))
    one = F.log(1 - WEIGHT * F.sqrt(nearness(apart)))
    near = pairs.groupBy("id").agg(F.sum(one).alias("s"))
    return full.join(near, "id", "left").select("id", F.round(1 - F.exp(F.coalesce("s", F.lit(0.0))), 6).alias("rank"))


def best(ranked: DataFrame, limit: int = 50) -> DataFrame:
    return ranked.orderBy(F.desc("rank"), F.desc("id")).limit(limit)


class StoredIndex:
    """positions() as a stored table that grows by increments; a search opens the folders of its words only."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Snapshots(spark, root, ["bucket"])

    def add(self, rows: DataFrame, batch: int, id_col: str = "id", text_col: str = "text") -> None:
        """Texts that the index doesn't have yet; a batch that was added before adds nothing."""
        bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int")
        # a folder's rows come from few tasks, so that it gets few files
        self.store.append(positions(rows, id_col, text_col).withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("token"), F.lit(8))), batch)

    def words(self, words: list[str]) -> DataFrame:
        """The index of these words."""
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        return self.store.read().where(F.col("bucket").isin(buckets) & F.col("token").isin(sorted(set(words)))).drop("bucket")


def fragments(rows: DataFrame, words: list[str], id_col: str = "id", text_col: str = "text", most: int = 2, least: int = 3, longest: int = 14) -> DataFrame:
    """id, snippet: up to `most` parts of the text with the words marked, joined by " ... ".

    A part is chosen among the windows of at most `longest` words that begin with a match: most different words, then
    most matches, then the shortest, then the first; the next one among those outside the parts before. A part is
    stretched to `longest` words, evenly where the text and the other parts allow it; a further part of fewer than
    `least` words isn't shown. Without a match the text's first `least` words are shown.
    """
    words = sorted(set(words))
    texts = rows.select(F.col(id_col).alias("id"), F.regexp_extract_all(text_col, F.lit(PIECE), F.lit(0)).alias("pieces"), F.size(T.tokens(F.col(text_col))).alias("n"), T.tokens(F.col(text_col)).alias("toks"))
    hits = texts.select("id", F.posexplode("toks").alias("pos", "word")).where(F.col("word").isin(words))
    w = Window.partitionBy("id").orderBy("pos").rangeBetween(0, longest - 1)
    windows = hits.select("id", F.col("pos").alias("begin"), F.max("pos").over(w).alias("end"), F.size(F.collect_set("word").over(w)).alias("different"), F.count("*").over(w).alias("hits"))
    value = F.struct("different", "hits", (F.col("begin") - F.col("end")).alias("short"), (-F.col("begin")).alias("early"))
    chosen = texts.select("id", "n", F.array().cast("array<struct<lo:int,hi:int>>").alias("parts"))
    for _ in range(most):
        free = windows.join(chosen, "id").where(F.forall("parts", lambda p: (F.col("begin") > p["hi"]) | (F.col("end") < p["lo"])))
        top = free.groupBy("id").agg(F.max_by(F.struct("begin", "end"), value).alias("one"))
        got = chosen.join(top, "id", "left")
        begin, end = F.col("one.begin"), F.col("one.end")
        floor = F.coalesce(F.array_max(F.transform(F.filter("parts", lambda p: p["hi"] < begin), lambda p: p["hi"])) + 1, F.lit(0))
        ceil = F.coalesce(F.array_min(F.transform(F.filter("parts", lambda p: p["lo"] > end), lambda p: p["lo"])) - 1, F.col("n") - 1)
        lo = F.greatest(begin - F.floor((longest - (end - begin + 1)) / 2).cast("int"), floor)
        hi = F.least(lo + longest - 1, ceil)
        lo = F.greatest(hi - longest + 1, floor)
        part = F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
        fits = F.col("one").isNotNull() & ((hi - lo + 1 >= least) | (F.size("parts") == 0))
        chosen = got.select("id", "n", F.when(fits, F.concat("parts", part)).otherwise(F.col("parts")).alias("parts"))
    first = F.array(F.struct(F.lit(0).alias("lo"), (F.least(F.col("n"), F.lit(least)) - 1).cast("int").alias("hi")))
    shown = chosen.select(F.col("id").alias("_id"), F.when(F.size("parts") > 0, F.array_sort("parts")).when(F.col("n") > 0, first).otherwise(F.col("parts")).alias("parts"))
    both = texts.join(shown, F.col("id") == F.col("_id"))
    word = lambda i: F.regexp_extract(F.get("pieces", i), r"^[\p{L}\p{N}_]+", 0)
    marked = lambda i: F.when(F.get("toks", i).isin(words), F.concat(F.lit("<b>"), word(i), F.lit("</b>"))).otherwise(word(i))
    gap = lambda i, p: F.when(i < p["hi"], F.regexp_replace(F.get("pieces", i), r"^[\p{L}\p{N}_]+", "")).otherwise("")
    said = F.transform("parts", lambda p: F.array_join(F.transform(F.sequence(p["lo"], p["hi"]), lambda i: F.concat(marked(i), gap(i, p))), ""))
    return both.select("id", F.array_join(said, " ... ").alias("snippet"))
