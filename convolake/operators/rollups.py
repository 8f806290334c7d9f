"""Usage rollups over the statistics scope. Every sum of tokens counts usage rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.tables import cut

from .scope import TOKENS, active_minutes


def _if(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def _used() -> Column:
    return F.col("usage_row")


def _said() -> Column:
    """Rows that count as messages: usage rows with a role."""
    return F.count(F.when(F.col("usage_row") & F.col("role").isNotNull(), 1))


def totals(scope: DataFrame) -> DataFrame:
    """One row. Sums are null where no usage row has a value; cost is never taken for zero."""
    sums = [F.sum(_if(_used(), F.col(c))).alias(c) for c in TOKENS]
    days = F.coalesce(F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000), F.lit(0)).cast("long")
    one = scope.agg(
        *sums,
        F.sum(_if(_used(), F.col("cost_cents"))).alias("cost_cents"),
        F.count(_if(_used() & F.col("cost_cents").isNotNull(), F.lit(1))).alias("priced_messages"),
        _said().alias("messages"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("project_id").alias("projects"),
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_message"),
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_message"),
        days.alias("days_span"),
    )
    return one.crossJoin(active_minutes(scope))


def daily(scope: DataFrame) -> DataFrame:
    rows = scope.where("ts is not null and usage_row")
    return rows.groupBy(F.to_date("ts_local").alias("date")).agg(
        F.sum("tokens").alias("total_tokens"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count("role").alias("messages"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct(F.hour("ts_local")).alias("active_hours"),
        F.sum("cost_cents").alias("cost_cents"),
    )


def heatmap(scope: DataFrame) -> DataFrame:
    """Messages and tokens by local hour and day of week (0: Sunday)."""
    rows = scope.where("ts is not null and usage_row")
    key = [F.hour("ts_local").alias("hour"), (F.dayofweek("ts_local") - 1).alias("dow")]
    return rows.groupBy(*key).agg(F.count("*").alias("activity"), F.sum("tokens").alias("total_tokens"))


def outcomes(results: DataFrame) -> DataFrame:
    """One outcome for each invocation of a session: failed if any of its results did."""
    return results.groupBy("session_id", "tool_use_id").agg(F.max("is_error").alias("failed"))


def tool_usage(scope: DataFrame, uses: DataFrame, results: DataFrame, top: int = 20) -> DataFrame:
    """Uses and success of tools, skills and sub-agents; the first `top` of each kind.

    Outcomes collapse before the join. Counting comes before ranking, so a rank sorts names, not uses.
    """
    rows = scope.select(F.col("id").alias("message_ref"))
    done = uses.join(rows, "message_ref").join(outcomes(results), ["session_id", "tool_use_id"], "left")
    failed = F.coalesce("failed", "is_error", F.lit(False))
    kinds = done.select(failed.alias("failed"), F.expr("stack(3, 'tool', tool_name, 'skill', skill_name, 'subagent', subagent_type) as (kind, name)"))
    counted = kinds.where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("uses"), F.count(F.when(~F.col("failed"), 1)).alias("ok"))
    w = Window.partitionBy("kind").orderBy(F.desc("uses"), "name")
    ranked = counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    return ranked.select("kind", "name", "uses", F.round(F.col("ok") / F.col("uses"), 6).alias("success_rate"))


def _model_sums() -> list[Column]:
    return [F.count("role").alias("messages"), F.sum("tokens").alias("total_tokens"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("cost_cents").alias("cost_cents")]


def models(scope: DataFrame) -> DataFrame:
    return scope.where("model is not null and usage_row").groupBy("model").agg(*_model_sums())


def model_split(scope: DataFrame, key: str) -> DataFrame:
    """Model usage within each value of key; sums to the parent rollup."""
    return scope.where("model is not null and usage_row").groupBy(key, "model").agg(*_model_sums())


def providers(scope: DataFrame) -> DataFrame:
    return scope.where("usage_row").groupBy("provider").agg(
        F.countDistinct("project_id").alias("projects"),
        F.countDistinct("session_id").alias("sessions"),
        F.count("role").alias("messages"),
        F.sum("tokens").alias("total_tokens"),
    )


def display_name() -> Column:
    return F.coalesce("project_name", "project_path", F.lit("(unknown)"))


def top_projects(scope: DataFrame, top: int = 10) -> DataFrame:
    """Projects by tokens; projects of one name are one row."""
    rows = scope.where("usage_row").groupBy(display_name().alias("project")).agg(
        F.countDistinct("session_id").alias("sessions"), F.count("role").alias("messages"), F.sum("tokens").alias("total_tokens")
    )
    return rows.orderBy(F.desc("total_tokens"), "project").limit(top)


def distribution(scope: DataFrame) -> DataFrame:
    """Shares of the four kinds of tokens, never below zero; reasoning is not recorded."""
    sums = scope.agg(*[F.greatest(F.coalesce(F.sum(F.when(F.col("usage_row"), F.col(c))), F.lit(0)), F.lit(0)).alias(c) for c in TOKENS])
    whole = F.col(TOKENS[0]) + F.col(TOKENS[1]) + F.col(TOKENS[2]) + F.col(TOKENS[3])
    return sums.select(*TOKENS, F.lit(0).cast("long").alias("reasoning_tokens"), whole.alias("total_tokens"))


def most_active_hour(scope: DataFrame) -> DataFrame:
    """Hour of the busiest (day of week, hour) cell; of equal cells the last in that order."""
    return heatmap(scope).orderBy(F.desc("activity"), F.desc("dow"), F.desc("hour")).limit(1).select("hour")


def project_summary(scope: DataFrame) -> DataFrame:
    """Totals of each project with whole tokens a session."""
    rows = scope.groupBy("project_id", display_name().alias("project")).agg(
        F.coalesce(F.sum(F.when(F.col("usage_row"), F.col("tokens"))), F.lit(0)).alias("total_tokens"), F.countDistinct("session_id").alias("sessions"), _said().alias("messages")
    )
    return rows.withColumn("tokens_per_session", F.expr("if(sessions = 0, 0, total_tokens div sessions)"))


def session_stats(scope: DataFrame) -> DataFrame:
    """Totals of each session."""
    return scope.groupBy("session_id", display_name().alias("project")).agg(
        *[F.sum(F.when(F.col("usage_row"), F.col(c))).alias(c) for c in TOKENS],
        F.coalesce(F.sum(F.when(F.col("usage_row"), F.col("tokens"))), F.lit(0)).alias("total_tokens"),
        _said().alias("messages"),
        F.sum(F.when(F.col("usage_row"), F.col("cost_cents"))).alias("cost_cents"),
        F.min("ts").alias("first_message"),
        F.max("ts").alias("last_message"),
    )


def session_page(scope: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Sessions by tokens, one page."""
    return session_stats(scope).orderBy(F.desc("total_tokens"), "session_id").offset(offset).limit(limit)


def session_comparison(scope: DataFrame) -> DataFrame:
    """Each session against its project: shares, ranks, and whether it is above the whole mean."""
    one = scope.where("usage_row").groupBy("project_id", "session_id").agg(
        F.sum("tokens").alias("tokens"), F.count("role").alias("messages"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span")
    )
    sums = one.groupBy(F.col("project_id").alias("_p")).agg(F.sum("tokens").alias("_tokens"), F.sum("messages").alias("_messages"), F.count("*").alias("_n"))
    placed = places_within(one, "project_id", [F.desc("tokens"), F.asc("session_id")], "token_rank")
    placed = places_within(placed, "project_id", [F.desc("span"), F.asc("session_id")], "duration_rank")
    return placed.join(sums, F.col("project_id").eqNullSafe(F.col("_p"))).select(
        "project_id",
        "session_id",
        F.round(100.0 * F.col("tokens") / F.col("_tokens"), 6).alias("tokens_percent"),
        F.round(100.0 * F.col("messages") / F.col("_messages"), 6).alias("messages_percent"),
        "token_rank",
        "duration_rank",
        (F.col("tokens") > F.floor(F.col("_tokens") / F.col("_n"))).alias("above_average"),
    )


def places_within(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) among those of one key, in the given order.

    Rows are dealt by ranges of key and order, so that a key's rows lie in as many ranges as they need; each range
    numbers its own, and the rows of the key in the ranges before are added (one row a key and range).
    """
    dealt = cut(rows.repartitionByRange(F.asc(key), *order).withColumn("_range", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    sizes = dealt.groupBy(F.col("_range").alias("_r"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_k").orderBy("_r")) - F.col("_n")).drop("_n")
    numbered = dealt.withColumn(name, local).join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")))
    return numbered.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_r", "_k", "_before")
