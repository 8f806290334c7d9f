"""Browsing, paging and project identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    """Limit between 1 and 200 (50 if unset), offset from 0."""
    return min(max(50 if limit is None else limit, 1), 200), max(offset or 0, 0)


def message_order(ts: str = "ts", seq: str = "seq", id_: str = "id") -> list[Column]:
    return [F.asc_nulls_last(ts), F.asc_nulls_last(seq), F.asc_nulls_last(id_)]


def browse(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None, **equal) -> DataFrame:
    """A page under the filters that are given; a filter of None is no filter."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    n, at = page(limit, offset)
    return df.orderBy(*order).offset(at).limit(n)


def in_project(df: DataFrame, name_or_path: str) -> DataFrame:
    return df.where((F.col("project_name") == name_or_path) | (F.col("project_path") == name_or_path))


def between_instants(df: DataFrame, from_=None, to=None, inclusive: bool = False) -> DataFrame:
    """Search takes both ends, message lists take [from, to)."""
    if from_ is not None:
        df = df.where(F.col("ts") >= F.lit(from_).cast("timestamp"))
    if to is not None:
        end = F.lit(to).cast("timestamp")
        df = df.where(F.col("ts") <= end if inclusive else F.col("ts") < end)
    return df


def session_positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """0-based place of each message in its session's browse order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1)


def tail_page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Pages from the end: offset 0 has each session's newest rows, given in their own order."""
    w = Window.partitionBy("session_id")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy("seq"))).withColumn("total", F.count("*").over(w))
    first, last = F.col("total") - offset - limit, F.col("total") - offset
    return placed.where((F.col("place") > first) & (F.col("place") <= last)).drop("total")


def identity_paths(projects: DataFrame, aliases: DataFrame, identity: str, worktrees: bool = True) -> DataFrame:
    """Paths of an identity: its members, unless only worktrees and these are unwanted, and its aliases."""
    members = projects.where(F.col("identity_key") == identity)
    if not worktrees:
        members = members.groupBy("project_path").agg(F.bool_and("git_worktree").alias("only")).where("not only")
    return members.select("project_path").union(aliases.where(F.col("identity_key") == identity).select("project_path")).distinct()


def identity_members(projects: DataFrame) -> DataFrame:
    return projects.where("identity_key is not null").groupBy("identity_key", "project_path").agg(
        F.bool_and("git_worktree").alias("worktree"), F.array_join(F.sort_array(F.collect_set("project_name")), ",").alias("names"), F.max("project_id").alias("last_project")
    )


def identity_names(projects: DataFrame) -> DataFrame:
    """Most frequent project name of an identity (then the first by name)."""
    counted = projects.where("identity_key is not null").groupBy("identity_key", "project_name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("identity_key").orderBy(F.desc("n"), "project_name")
    return counted.withColumn("r", F.row_number().over(w)).where("r = 1").select("identity_key", F.col("project_name").alias("display_name"))


def identity_names_by_activity(projects: DataFrame, active: DataFrame) -> DataFrame:
    """Basename of the identity's path that was active last; active(project_id, last_active)."""
    rows = projects.join(active, "project_id")
    base = F.regexp_extract(F.max_by("project_path", F.struct("last_active", "project_path")), r"([^/\\]+)[/\\]*$", 1)
    return rows.groupBy("identity_key").agg(base.alias("display_name"))


def orphans(sessions: DataFrame, projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Projects in use that have no identity and no alias."""
    used = sessions.join(projects, "project_id").where("git_worktree").select("project_path").distinct()
    return used.join(aliases.select("project_path"), "project_path", "left_anti")


def identity_key(root: str, remote: str) -> Column:
    """g:<root>|<remote>, g:<root>, r:<remote> or null."""
    a, b = F.nullif(F.col(root), F.lit("")), F.nullif(F.col(remote), F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("g:"), a, F.lit("|"), b)).when(a.isNotNull(), F.concat(F.lit("g:"), a)).when(b.isNotNull(), F.concat(F.lit("r:"), b))


def pair_worktrees(projects: DataFrame) -> DataFrame:
    """Worktrees beside the main project of the same parent directory; lone worktrees have none."""
    parent = F.regexp_replace("project_path", "/[^/]*$", "")
    main = projects.where("not git_worktree").groupBy(parent.alias("parent")).agg(F.min("project_path").alias("main_path"))
    return projects.where("git_worktree").select("project_path", parent.alias("parent")).join(main, "parent", "left").select("project_path", "main_path")


def by_directory(projects: DataFrame) -> DataFrame:
    return projects.groupBy(F.regexp_replace("project_path", "/[^/]*$", "").alias("directory")).agg(F.count("*").alias("projects"), F.min("project_name").alias("first_project"))
