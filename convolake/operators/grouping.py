"""Projects as one list: rows of one identity are a group, and no two groups have the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deepest suffix of parent directories that tells groups of one name apart.
DEEPEST = 6


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, r"[\\/]"), lambda p: p != "")


def groups(projects: DataFrame, aliases: DataFrame | None = None, worktrees: bool = True) -> DataFrame:
    """One row a group: key, identity_key, name, suffix, label, path, paths, rows, providers, machines, last_modified.

    projects: machine, provider, project_path, identity_key, git_worktree, last_modified; aliases: project_path, identity_key.
    A row belongs to its identity, or its path's alias, or the one identity that other rows of its path have; else to its
    path. A path that two identities claim decides nothing. A path is a worktree where all its rows say so; without
    worktrees these are left out. The group is named after the path changed last (of equal ones the first); where names collide
    the parent directory is added, then up to DEEPEST directories for those that still collide.
    """
    if aliases is None:
        rows = projects.withColumn("_alias", F.lit(None).cast("string"))
    else:
        alias = aliases.groupBy(F.col("project_path").alias("_path")).agg(F.max("identity_key").alias("_alias"))
        rows = projects.join(alias, F.col("project_path") == F.col("_path"), "left").drop("_path")
    rows = rows.withColumn("_own", F.coalesce("identity_key", "_alias"))
    claims = rows.where("_own is not null").groupBy(F.col("project_path").alias("_path")).agg(F.min("_own").alias("_low"), F.max("_own").alias("_high"))
    rows = rows.join(claims, F.col("project_path") == F.col("_path"), "left")
    identity = F.coalesce("_own", F.when(F.col("_low") == F.col("_high"), F.col("_low")))
    rows = rows.withColumn("_identity", identity).withColumn("key", F.coalesce("_identity", F.concat(F.lit("path:"), "project_path")))
    paths = rows.groupBy("key", "project_path").agg(F.first("_identity").alias("identity_key"), F.bool_and(F.coalesce("git_worktree", F.lit(False))).alias("_worktree"), F.max("last_modified").alias("_modified"), F.count("*").alias("_n"), F.collect_set("provider").alias("_providers"), F.collect_set("machine").alias("_machines"))
    if not worktrees:
        paths = paths.where(~F.col("_worktree"))
    order = F.struct(F.col("_modified").isNull().alias("unknown"), (-F.unix_micros(F.col("_modified").cast("timestamp"))).alias("age"), "project_path")
    out = paths.groupBy("key").agg(
        F.first("identity_key").alias("identity_key"),
        F.min_by("project_path", order).alias("path"),
        F.count("*").alias("paths"),
        F.sum("_n").alias("rows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_providers")))).alias("providers"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_machines")))).alias("machines"),
        F.max("_modified").alias("last_modified"),
    )
    parts = _parts(F.col("path"))
    out = out.withColumn("_parents", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).withColumn("name", F.coalesce(F.try_element_at(parts, F.lit(-1)), F.col("path")))
    out = out.withColumn("suffix", F.lit(None).cast("string")).withColumn("label", F.col("name"))
    for depth in range(1, DEEPEST + 1):
        shared = out.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_same")).where("_same > 1")
        wider = F.nullif(F.array_join(F.slice("_parents", F.greatest(F.size("_parents") - depth + 1, F.lit(1)), depth), "/"), F.lit(""))
        out = out.join(shared, F.col("label") == F.col("_label"), "left")
        out = out.withColumn("suffix", F.when(F.col("_same").isNotNull(), F.coalesce(wider, "suffix")).otherwise(F.col("suffix"))).drop("_label", "_same")
        out = out.withColumn("label", F.when(F.col("suffix").isNotNull(), F.concat_ws(" — ", "name", "suffix")).otherwise(F.col("name")))
    return out.drop("_parents")
