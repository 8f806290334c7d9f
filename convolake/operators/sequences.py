"""Ordered folds within a session: gaps, islands, deltas, as-of merges, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.tables import cut, drop


def break_periods(rows: DataFrame, gap_minutes: int = 120) -> DataFrame:
    """Active minutes of a session: periods end at gaps over gap_minutes; each counts one minute at least."""
    w = Window.partitionBy("session_id").orderBy("ts")
    whole = F.floor((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 60_000_000)
    parts = rows.where("ts is not null").withColumn("new", F.coalesce((whole > gap_minutes).cast("int"), F.lit(0)))
    parts = parts.withColumn("period", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("session_id", "period").agg(F.greatest(F.lit(1), F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60_000_000)).alias("minutes"))
    return spans.groupBy("session_id").agg(F.sum("minutes").cast("long").alias("active_minutes"), F.count("*").alias("periods"))


def streaks(days: DataFrame, by: str) -> DataFrame:
    """Longest run of consecutive days of each key, and the run that the last day ends."""
    w = Window.partitionBy(by).orderBy("day")
    runs = days.select(by, "day").distinct().withColumn("island", F.date_sub("day", F.row_number().over(w)))
    runs = runs.groupBy(by, "island").agg(F.count("*").alias("days"), F.max("day").alias("last_day"))
    return runs.groupBy(by).agg(F.max("days").alias("longest"), F.max_by("days", "last_day").alias("latest"), F.max("last_day").alias("last_day"))


def current_streaks(days: DataFrame, by: str, today: str) -> DataFrame:
    """streaks() with `current`: the run that the last day ends, where that is today or the day before; else 0."""
    recent = F.col("last_day").between(F.date_sub(F.lit(today).cast("date"), 1), F.lit(today).cast("date"))
    return streaks(days, by).withColumn("current", F.when(recent, F.col("latest")).otherwise(0).cast("long"))


def runs_of_equal(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Runs of consecutive rows of a session with one key."""
    w = Window.partitionBy("session_id").orderBy(*order)
    marked = rows.withColumn("new", (~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("session_id", "run").agg(F.first(key).alias(key), F.count("*").alias("n"))


def date_dividers(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows whose date differs from that of the timed row before them."""
    w = Window.partitionBy("session_id").orderBy(*order)
    before = F.last(F.to_date("ts_local"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(F.col("ts_local").isNotNull() & ~F.to_date("ts_local").eqNullSafe(F.col("before"))).drop("before")


def counter_deltas(rows: DataFrame, counters: list[str], order: list[str]) -> DataFrame:
    """Deltas of cumulative counters within a session: the first row's totals, then the growth, never below zero."""
    w = Window.partitionBy("session_id").orderBy(*order)
    return rows.select("*", *[F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)).alias(f"{c}_delta") for c in counters])


def latest_before(results: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """As-of merge: each result with the last use of its key before it (position `pos` in both).

    One union and one window per key carry the last use forward, so no pair of the key is formed.
    """
    both = uses.select(*keys, "pos", F.col("pos").alias("use_pos"), F.lit(0).alias("side")).unionByName(results.select(*keys, "pos", F.lit(None).cast("long").alias("use_pos"), F.lit(1).alias("side")))
    # a result comes before a use of the same place, as only earlier uses count
    w = Window.partitionBy(*keys).orderBy("pos", F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("use_pos", F.when(F.col("side") == 1, F.last("use_pos", ignorenulls=True).over(w))).where("side = 1").drop("side")


def leader_groups(rows: DataFrame, seconds: float) -> DataFrame:
    """Groups whose members lie within `seconds` of the group's first row (its leader), an ordered fold.

    Rows of a session stream through one task in order; only the leader is held.
    """
    schema = "session_id long, id long, leader long"

    def run(batches):
        import pandas as pd

        session, leader, since = None, None, None
        for pdf in batches:
            out = []
            for s, i, t in zip(pdf.session_id, pdf.id, pdf.us):
                if s != session or t - since > seconds * 1e6:
                    session, leader, since = s, i, t
                out.append((s, i, leader))
            yield pd.DataFrame(out, columns=["session_id", "id", "leader"])

    ordered = rows.where("ts is not null").select("session_id", "id", F.unix_micros("ts").alias("us")).repartition("session_id").sortWithinPartitions("session_id", "us", "id")
    return ordered.mapInPandas(run, schema)


def tree_depths(edges: DataFrame) -> DataFrame:
    """Depth and root of each node of a forest (node, parent), by doubling the distance looked back.

    Each round joins nodes with the ancestors found so far, so a chain of depth d needs log2(d) rounds, however
    deep; a node that never meets a root (a cycle, a missing parent) is left out after log2(number of nodes) rounds.
    """
    root = F.col("parent").isNull()
    now = cut(edges.select("node", F.coalesce("parent", "node").alias("up"), F.when(root, 0).otherwise(1).alias("depth"), root.alias("done")))
    for _ in range(now.count().bit_length() + 1):
        if now.where("not done").isEmpty():
            break
        other = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("done").alias("done2"))
        far = now.where("not done").join(other, "up").select("node", F.col("up2").alias("up"), F.try_add("depth", "more").alias("depth"), F.col("done2").alias("done"))
        last, now = now, cut(far.unionByName(now.where("done")))
        drop(last)
    return now.where("done").select("node", F.col("up").alias("root"), "depth")
