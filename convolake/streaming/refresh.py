"""Incremental maintenance of the read model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def overlap_rows(source: DataFrame, mirror: DataFrame, overlap: int = 50_000) -> DataFrame:
    """Rows to add: ids above the mirror's highest less the overlap that it lacks; late commits are found again."""
    top = mirror.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = source.join(F.broadcast(top), F.col("id") > F.col("top") - overlap).drop("top")
    return fresh.join(mirror.select("id"), "id", "left_anti")


def merged(mirror: DataFrame, rows: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """The mirror after rows came: "ignore" adds those whose key it lacks, "replace" puts them in the place of those of
    their key, "full" leaves nothing but them. Of rows with one key one stays."""
    rows = rows.dropDuplicates([key]).select(mirror.columns)
    if mode == "full":
        return rows
    if mode == "ignore":
        return mirror.unionByName(rows.join(mirror.select(key), key, "left_anti"))
    if mode == "replace":
        return mirror.join(rows.select(key), key, "left_anti").unionByName(rows)
    raise ValueError(f"unknown mode {mode!r}")


def mark_new(fresh: DataFrame, mirror: DataFrame) -> DataFrame:
    """fresh with usage_row: the lowest new id of a group that the mirror has no row of.

    A row that comes late with an older time but a higher id never takes the marker.
    """
    known = mirror.select("session_id", "group_key").distinct().withColumn("known", F.lit(True))
    first = fresh.groupBy("session_id", "group_key").agg(F.min("id").alias("first"))
    rows = fresh.join(first, ["session_id", "group_key"]).join(known, ["session_id", "group_key"], "left")
    return rows.withColumn("usage_row", (F.col("id") == F.col("first")) & F.col("known").isNull()).drop("first", "known")


def refresh(spark: SparkSession, source: DataFrame, path: str, overlap: int = 50_000) -> int:
    """One refresh of the mirror at path; returns how many rows came."""
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        source.limit(0).withColumn("usage_row", F.lit(True)).write.parquet(path)
    mirror = spark.read.parquet(path)
    fresh = mark_new(overlap_rows(source, mirror, overlap), mirror).select(mirror.columns).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def mirror_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to the mirror; replayed batches add nothing, so the effect is once."""

    def add(batch: DataFrame, _: int) -> None:
        refresh(batch.sparkSession, batch.dropDuplicates(["id"]), path, 1 << 62)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_stream(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Messages and tokens by logical day (from 04:00), late rows kept up to the watermark."""
    rows = stream.withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", "1 day", "1 day", "4 hours").alias("w")).agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens")).select(F.to_date("w.start").alias("date"), "messages", "tokens")


def session_stream(stream: DataFrame, gap: str = "120 minutes", lateness: str = "2 hours") -> DataFrame:
    rows = stream.withWatermark("ts", lateness)
    return rows.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("messages")).select("session_id", F.col("w.start").alias("start"), "messages")


def lag(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """Ids that the mirror is behind, and its status."""
    s, m = source.agg(F.max("id").alias("s")), mirror.agg(F.max("id").alias("m"))
    behind = F.coalesce("s", F.lit(0)) - F.coalesce("m", F.lit(0))
    return s.crossJoin(m).select(behind.alias("behind"), F.when(F.col("m").isNull(), "warming").when(behind > 0, "lagging").otherwise("ok").alias("status"))


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose size or time differs from what was seen."""
    return files.join(seen, ["path", "size", "modified"], "left_anti")


def retry_after(attempts: DataFrame, grace: int = 3, base_minutes: int = 15, cap_minutes: int = 1440) -> DataFrame:
    """When a key may be tried again: at once for under `grace` failures, then 15 minutes doubled each time, a day at most.

    Failures count from the last success or change of the key.
    """
    resets = attempts.where("outcome <> 'failed'").groupBy("key").agg(F.max("at").alias("reset"))
    rows = attempts.where("outcome = 'failed'").join(resets, "key", "left").where("reset is null or at > reset")
    per = rows.groupBy("key").agg(F.count("*").alias("failures"), F.max("at").alias("last"))
    over = F.col("failures") - grace
    minutes = F.when(over < 0, 0).otherwise(F.least(F.lit(cap_minutes), base_minutes * F.pow(F.lit(2.0), F.least(over, F.lit(16))))).cast("int")
    return per.withColumn("wait_minutes", minutes).select("key", "failures", "wait_minutes", F.expr("timestampadd(MINUTE, wait_minutes, last)").alias("retry_at"))
