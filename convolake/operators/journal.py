"""Logical days, work lists and journal health. A logical day starts at 04:00 UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = "interval 4 hours"


def logical_day(ts: str = "ts") -> Column:
    return F.to_date(F.col(ts) - F.expr(SHIFT))


def since_day(df: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """Rows of logical days from `day` on, as a bound on the stored instant so that it reaches the scan."""
    return df.where(F.col(ts) >= F.lit(day).cast("date").cast("timestamp") + F.expr(SHIFT))


def session_days(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(entry_date, project_id, session_id) with the latest arrival; rows without time have no day."""
    rows = messages.where("ts is not null").groupBy(logical_day().alias("entry_date"), "session_id").agg(F.max("id").alias("latest_id"), F.max("ts").alias("latest"))
    return rows.join(sessions, "session_id")


def day_groups(days: DataFrame) -> DataFrame:
    """Sessions of each (day, project) as one ordered list."""
    return days.groupBy("entry_date", "project_id").agg(F.sort_array(F.collect_list("session_id")).alias("session_ids"), F.max("latest_id").alias("latest_id"), F.max("latest").alias("latest"))


def pending(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Groups without an entry, with other sessions than their entry names, or with rows past its snapshot."""
    e = entries.select(F.col("entry_date").alias("_d"), F.col("project_id").alias("_p"), F.col("session_ids").alias("_ids"), "snapshot_id")
    both = groups.join(e, (F.col("entry_date") == F.col("_d")) & (F.col("project_id") == F.col("_p")), "left")
    reason = F.when(F.col("_d").isNull(), "missing").when(~F.col("session_ids").eqNullSafe(F.array_sort(F.array_distinct("_ids"))), "sessions").when(F.col("latest_id") > F.col("snapshot_id"), "stale")
    return both.withColumn("reason", reason).where("reason is not null").select("entry_date", "project_id", "reason")


def provenance_ok(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether an entry names exactly its group's sessions: both differences empty."""
    e = entries.select(F.col("entry_date"), F.col("project_id"), F.col("session_ids").alias("named"))
    both = e.join(groups, ["entry_date", "project_id"], "left")
    have = F.coalesce("session_ids", F.expr("cast(array() as array<bigint>)"))
    ok = (F.size(F.array_except("named", have)) == 0) & (F.size(F.array_except(have, F.col("named"))) == 0)
    return both.select("entry_date", "project_id", ok.alias("exact"))


def health(groups: DataFrame, ticks: DataFrame, now: str, grace_hours: int) -> DataFrame:
    """One row: pending groups, ticks of the last day, and the status (no_tick before stale before ok)."""
    at = F.lit(now).cast("timestamp")
    g = groups.agg(F.count("*").alias("groups"), F.max("latest").alias("latest"))
    t = ticks.agg(F.max("tick_at").alias("last_tick"), F.count(F.when(F.col("tick_at") > at - F.expr("interval 24 hours"), 1)).alias("ticks_last_day"))
    late = at > F.col("latest") + F.expr(f"interval {int(grace_hours)} hours")
    return g.crossJoin(t).select("groups", "ticks_last_day", F.when(F.col("last_tick").isNull(), "no_tick").when(late, "stale").otherwise("ok").alias("status"))


def freshness(machines: DataFrame, seen: DataFrame, now: str, threshold_s: int, excluded: list[str] = ()) -> DataFrame:
    """Machines with the age of what they sent last; excluded hosts report but never alert."""
    last = seen.groupBy("machine_id").agg(F.max("ts").alias("last_seen"))
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_seen")) / 1_000_000)
    alert = F.coalesce((age > threshold_s) & ~F.col("hostname").isin(list(excluded)), F.lit(False)) if excluded else F.coalesce(age > threshold_s, F.lit(False))
    return machines.join(last, "machine_id", "left").select("machine_id", "hostname", age.alias("age_s"), alert.alias("alert"))
