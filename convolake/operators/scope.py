"""The statistics scope: stored messages with their project, local time and usage marker."""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


@dataclass(frozen=True)
class StatsWindow:
    """Inclusive local dates and the zone they are counted in; bad values are rejected before planning."""

    from_: str | None = None
    to: str | None = None
    tz: str = "UTC"

    def __post_init__(self):
        if self.tz not in zoneinfo.available_timezones():
            raise ValueError(f"unknown time zone {self.tz!r}")
        dates = [date.fromisoformat(d) for d in (self.from_, self.to) if d]
        if len(dates) == 2 and dates[0] > dates[1]:
            raise ValueError("the window ends before it starts")

    def instants(self) -> tuple[datetime | None, datetime | None]:
        """Instants that no message of the window comes before or after. They lie some hours outside it, as clocks are also put back at midnight."""
        zone, slack = zoneinfo.ZoneInfo(self.tz), timedelta(hours=3)
        midnight = lambda day, days: datetime.combine(date.fromisoformat(day) + timedelta(days=days), datetime.min.time(), zone).astimezone(timezone.utc)
        return (midnight(self.from_, 0) - slack if self.from_ else None, midnight(self.to, 1) + slack if self.to else None)


def mark_usage_rows(messages: DataFrame) -> DataFrame:
    """usage_row: the row with the lowest id of each (session, group); only it counts towards usage.

    A partial minimum and an equi-join rather than a window over each group, so that no group of
    duplicates is sorted in one task.
    """
    first = messages.groupBy(F.col("session_id").alias("_s"), F.col("group_key").alias("_g")).agg(F.min("id").alias("_first"))
    joined = messages.join(first, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("group_key").eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("usage_row", F.col("id") == F.col("_first")).drop("_s", "_g", "_first")


def total_tokens() -> Column:
    """Sum of the four token counts of a row; an unknown count is none."""
    out = F.lit(0).cast("long")
    for c in TOKENS:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def stats_scope(messages: DataFrame, sessions: DataFrame, projects: DataFrame, window: StatsWindow = StatsWindow(), paths: DataFrame | None = None, provider: str | None = None, session_id=None) -> DataFrame:
    """Messages of the window joined to session and (optional) project.

    Filters come first: those of the window as instants too, which reach the scan of stored messages, before local dates
    decide; rows without time drop only where a bound is set.
    paths(project_path) restricts by semi join.
    """
    rows = messages
    if provider is not None:
        rows = rows.where(F.col("provider") == provider)
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    first, last = window.instants()
    if first:
        rows = rows.where(F.col("ts") >= F.lit(first))
    if last:
        rows = rows.where(F.col("ts") <= F.lit(last))
    rows = rows.withColumn("ts_local", F.from_utc_timestamp("ts", window.tz))
    if window.from_:
        rows = rows.where(F.to_date("ts_local") >= F.lit(window.from_).cast("date"))
    if window.to:
        rows = rows.where(F.to_date("ts_local") <= F.lit(window.to).cast("date"))
    out = rows.join(sessions, "session_id").join(projects, "project_id", "left").withColumn("tokens", total_tokens())
    return out.join(paths, "project_path", "left_semi") if paths is not None else out


def active_minutes(scope: DataFrame, by: list[str] | None = None, idle: int = 1800) -> DataFrame:
    """Minutes of gaps of at most `idle` seconds between consecutive messages of a session."""
    w = Window.partitionBy("session_id").orderBy("ts")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6
    gaps = scope.where("ts is not null").select(*(by or []), "session_id", gap.alias("gap")).where((F.col("gap") > 0) & (F.col("gap") <= idle))
    minutes = F.bround(F.coalesce(F.sum("gap"), F.lit(0.0)) / 60).cast("long").alias("active_minutes")
    return gaps.groupBy(*by).agg(minutes) if by else gaps.agg(minutes)
