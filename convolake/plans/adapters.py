"""The archive's tables over the star-schema Parquet tables, and the same projections as SQL.

messages <- events, sessions <- users of events, projects <- nation, machines <- region,
tool invocations and outcomes <- lineitem. Every projection is narrow, so that only the named
columns reach the scan. Messages (with their usage marker) and sessions are stored once, as an archive has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.operators.scope import mark_usage_rows
from convolake.streaming.snapshots import Snapshots
from convolake.tables import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() makes of a table, as ingest would store it: made once an application for the source as it is, then read.

    Every rollup needs the usage marker and the sessions; making them is two shuffles of all messages.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = f"{path} {files.getFileStatus(path).getModificationTime()} {files.getContentSummary(path).getLength()}"
    store = Snapshots(spark, f"{scratch(spark)}/stored/{name}-{hashlib.sha256(state.encode()).hexdigest()[:24]}")
    if store.pointer() is None:
        store.rebuild(build)
    return store.read()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "messages", "events", lambda: _messages(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    out = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"),
        k.cast("string").alias("group_key"),
        F.when(F.col("event_type") != "error", F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant")).alias("role"),
        cents.alias("input_tokens"),
        F.expr("cast(round(value * 100) as bigint) div 2").alias("output_tokens"),
        (cents % 7).alias("cache_creation_tokens"),
        (cents % 11).alias("cache_read_tokens"),
        F.when(F.col("event_type") == "purchase", cents).alias("cost_cents"),
    )
    return mark_usage_rows(out)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda: table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("user_id") % 25).cast("int").alias("project_id")).distinct()
    return stored(spark, sf_dir, "sessions", "events", rows)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("project_id"),
        F.col("n_name").alias("project_name"),
        F.concat("r_name", F.lit("/"), "n_name").alias("project_path"),
        F.col("r_name").alias("identity_key"),
        (F.col("n_nationkey") % 5 == 0).alias("git_worktree"),
        F.col("n_regionkey").alias("machine_id"),
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("machine_id"), F.col("r_name").alias("hostname"))


def tool_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations refer to messages by order key; skill and sub-agent names are set for some."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("message_ref"),
        (F.col("l_orderkey") % 150).alias("session_id"),
        F.col("l_linenumber").alias("seq"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tool_use_id"),
        F.col("l_returnflag").alias("tool_name"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("skill_name"),
        F.when(F.col("l_quantity") > 40, F.concat(F.lit("agent"), F.col("l_linenumber").cast("string"))).alias("subagent_type"),
        (F.col("l_tax") > 0.06).alias("is_error"),
    )


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == 0).select(
        (F.col("l_orderkey") % 150).alias("session_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tool_use_id"),
        (F.col("l_discount") > 0.05).alias("is_error"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


MESSAGES = """messages AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, group_key ORDER BY id) = 1 AS usage_row FROM (
    SELECT event_id AS id, user_id AS session_id, ts, event_type AS provider, 'm' || (k % 5) AS model, CAST(k AS VARCHAR) AS group_key,
      CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END END AS role,
      cents AS input_tokens, cents // 2 AS output_tokens, cents % 7 AS cache_creation_tokens, cents % 11 AS cache_read_tokens,
      CASE WHEN event_type = 'purchase' THEN cents END AS cost_cents
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events)))"""
SESSIONS = "sessions AS (SELECT DISTINCT user_id AS session_id, CAST(user_id % 25 AS INTEGER) AS project_id FROM events)"
PROJECTS = "projects AS (SELECT n_nationkey AS project_id, n_name AS project_name, r_name || '/' || n_name AS project_path, r_name AS identity_key, n_nationkey % 5 = 0 AS git_worktree, n_regionkey AS machine_id FROM nation JOIN region ON n_regionkey = r_regionkey)"
TOOL_USES = """tool_uses AS (SELECT l_orderkey AS message_ref, l_orderkey % 150 AS session_id, l_linenumber AS seq, l_orderkey || '-' || l_linenumber AS tool_use_id,
  l_returnflag AS tool_name, nullif(l_linestatus, 'O') AS skill_name, CASE WHEN l_quantity > 40 THEN 'agent' || l_linenumber END AS subagent_type, l_tax > 0.06 AS is_error FROM lineitem)"""
TOOL_RESULTS = "tool_results AS (SELECT l_orderkey % 150 AS session_id, l_orderkey || '-' || l_linenumber AS tool_use_id, l_discount > 0.05 AS is_error FROM lineitem WHERE l_linenumber % 2 = 0)"
SCOPE = """scope AS (SELECT m.*, p.project_id, p.project_name, p.project_path, p.identity_key, (m.ts AT TIME ZONE 'UTC') AT TIME ZONE '{tz}' AS ts_local,
  m.input_tokens + m.output_tokens + m.cache_creation_tokens + m.cache_read_tokens AS tokens
  FROM messages m JOIN sessions s USING (session_id) LEFT JOIN projects p USING (project_id))"""


def scoped(tz: str = "Europe/Rome") -> str:
    """SQL for the statistics scope and all it needs."""
    return ", ".join([MESSAGES, SESSIONS, PROJECTS, SCOPE.format(tz=tz)])
