"""All queries of the archive engine with their SQL twins.

A query is registered with the id of its operator; its SQL says the same over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.functions import vectors as V
from convolake.operators import board, browse, ingest, journal, rollups, scope, search, sequences

from . import adapters as A

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

ROME = scope.StatsWindow(tz="Europe/Rome")
TOK = "sum({0}) FILTER (WHERE usage_row)"


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    from . import archive, more  # noqa: F401  they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict:
    from . import archive, more  # noqa: F401

    return dict(_SQL)


def scoped(s: SparkSession, d: str, window: scope.StatsWindow = ROME, **more) -> DataFrame:
    return scope.stats_scope(A.messages(s, d), A.sessions(s, d), A.projects(s, d), window, **more)


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in scope.TOKENS)
_SUMS_USED = ", ".join(f"CAST(sum({c}) FILTER (WHERE usage_row) AS BIGINT) AS {c}" for c in scope.TOKENS)
_WITH = f"WITH {A.scoped()} "
_ACTIVE = """CAST(round_even(coalesce(sum(gap), 0) / 60, 0) AS BIGINT)"""
_GAPS = "gaps AS (SELECT session_id, provider, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts))) / 1e6 AS gap FROM scope WHERE ts IS NOT NULL)"


@query("a01_totals", _WITH + f""", {_GAPS}, act AS (SELECT {_ACTIVE} AS active_minutes FROM gaps WHERE gap > 0 AND gap <= 1800)
SELECT {_SUMS_USED}, CAST(sum(cost_cents) FILTER (WHERE usage_row) AS BIGINT) AS cost_cents, count(cost_cents) FILTER (WHERE usage_row) AS priced_messages,
 count(*) FILTER (WHERE usage_row AND role IS NOT NULL) AS messages, count(DISTINCT session_id) AS sessions, count(DISTINCT project_id) AS projects,
 strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_message, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_message,
 coalesce((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000, 0) AS days_span, any_value(active_minutes) AS active_minutes FROM scope, act""")
def _(s, d):
    return rollups.totals(scoped(s, d))


@query("a02_daily", _WITH + """SELECT CAST(ts_local AS DATE) AS date, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(role) AS messages, count(DISTINCT session_id) AS sessions, count(DISTINCT hour(ts_local)) AS active_hours,
 CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM scope WHERE usage_row AND ts IS NOT NULL GROUP BY 1""")
def _(s, d):
    return rollups.daily(scoped(s, d))


_HEAT = "SELECT CAST(hour(ts_local) AS INTEGER) AS hour, CAST(dayofweek(ts_local) AS INTEGER) AS dow, count(*) AS activity, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM scope WHERE usage_row AND ts IS NOT NULL GROUP BY 1, 2"


@query("a03_heatmap", _WITH + _HEAT)
def _(s, d):
    return rollups.heatmap(scoped(s, d))


_TOOLS = f"WITH {A.scoped()}, {A.TOOL_USES}, {A.TOOL_RESULTS}, outcome AS (SELECT session_id, tool_use_id, bool_or(is_error) AS failed FROM tool_results GROUP BY 1, 2), done AS (SELECT u.tool_name, u.skill_name, u.subagent_type, coalesce(o.failed, u.is_error, false) AS failed FROM tool_uses u JOIN scope m ON m.id = u.message_ref LEFT JOIN outcome o ON o.session_id = u.session_id AND o.tool_use_id = u.tool_use_id), kinds AS (SELECT 'tool' AS kind, tool_name AS name, failed FROM done UNION ALL SELECT 'skill', skill_name, failed FROM done UNION ALL SELECT 'subagent', subagent_type, failed FROM done), counted AS (SELECT kind, name, count(*) AS uses, count(*) FILTER (WHERE NOT failed) AS ok FROM kinds WHERE name IS NOT NULL GROUP BY 1, 2) "


@query("a04_tool_usage", _TOOLS + "SELECT kind, name, uses, round(ok / uses, 6) AS success_rate FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY uses DESC, name) AS place FROM counted) WHERE place <= 20")
def _(s, d):
    return rollups.tool_usage(scoped(s, d), A.tool_uses(s, d), A.tool_results(s, d))


_MODEL = f"count(role) AS messages, CAST(sum(tokens) AS BIGINT) AS total_tokens, {_SUMS}, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM scope WHERE usage_row AND model IS NOT NULL"


@query("a05_models", _WITH + f"SELECT model, {_MODEL} GROUP BY 1")
def _(s, d):
    return rollups.models(scoped(s, d))


@query("a06_model_split", _WITH + f"SELECT provider, model, {_MODEL} GROUP BY 1, 2")
def _(s, d):
    return rollups.model_split(scoped(s, d), "provider")


@query("a07_providers", _WITH + "SELECT provider, count(DISTINCT project_id) AS projects, count(DISTINCT session_id) AS sessions, count(role) AS messages, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM scope WHERE usage_row GROUP BY 1")
def _(s, d):
    return rollups.providers(scoped(s, d))


_NAME = "coalesce(project_name, project_path, '(unknown)') AS project"


@query("a08_top_projects", _WITH + f"SELECT {_NAME}, count(DISTINCT session_id) AS sessions, count(role) AS messages, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM scope WHERE usage_row GROUP BY 1 ORDER BY total_tokens DESC, project LIMIT 10")
def _(s, d):
    return rollups.top_projects(scoped(s, d))


@query("a09_distribution", _WITH + f", x AS (SELECT {_SUMS_USED} FROM scope) SELECT *, CAST(0 AS BIGINT) AS reasoning_tokens, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens FROM x")
def _(s, d):
    return rollups.distribution(scoped(s, d))


@query("a10_most_active_hour", _WITH + f", h AS ({_HEAT}) SELECT hour FROM h ORDER BY activity DESC, dow DESC, hour DESC LIMIT 1")
def _(s, d):
    return rollups.most_active_hour(scoped(s, d))


@query("a10_project_summary", _WITH + f", x AS (SELECT project_id, {_NAME}, CAST(coalesce(sum(tokens) FILTER (WHERE usage_row), 0) AS BIGINT) AS total_tokens, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE usage_row AND role IS NOT NULL) AS messages FROM scope GROUP BY 1, 2) SELECT *, total_tokens // sessions AS tokens_per_session FROM x")
def _(s, d):
    return rollups.project_summary(scoped(s, d))


_SESSION = f"SELECT session_id, {_NAME}, {_SUMS_USED}, CAST(coalesce(sum(tokens) FILTER (WHERE usage_row), 0) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE usage_row AND role IS NOT NULL) AS messages, CAST(sum(cost_cents) FILTER (WHERE usage_row) AS BIGINT) AS cost_cents, min(ts) AS first_message, max(ts) AS last_message FROM scope GROUP BY 1, 2"


def _plain_times(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("a11_session_stats", _WITH + _SESSION)
def _(s, d):
    return _plain_times(rollups.session_stats(scoped(s, d)), "first_message", "last_message")


@query("a23_session_page", _WITH + f"{_SESSION} ORDER BY total_tokens DESC, session_id LIMIT 20 OFFSET 20")
def _(s, d):
    return _plain_times(rollups.session_page(scoped(s, d), 20, 20), "first_message", "last_message")


@query("a12_identity_members", f"WITH {A.PROJECTS} SELECT identity_key, project_path, bool_and(git_worktree) AS worktree, array_to_string(list_sort(list(DISTINCT project_name)), ',') AS names, max(project_id) AS last_project FROM projects WHERE identity_key IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return browse.identity_members(A.projects(s, d))


@query("a13_identity_names", f"WITH {A.PROJECTS} SELECT identity_key, project_name AS display_name FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY n DESC, project_name) AS r FROM (SELECT identity_key, project_name, count(*) AS n FROM projects WHERE identity_key IS NOT NULL GROUP BY 1, 2)) WHERE r = 1")
def _(s, d):
    return browse.identity_names(A.projects(s, d))


@query("a14_identity_names_by_activity", f"WITH {A.scoped()}, act AS (SELECT project_id, max(ts) AS last_active FROM scope GROUP BY 1) SELECT identity_key, regexp_extract(project_path, '([^/]+)$', 1) AS display_name FROM (SELECT p.*, row_number() OVER (PARTITION BY identity_key ORDER BY last_active DESC, project_path DESC) AS r FROM projects p JOIN act USING (project_id)) WHERE r = 1")
def _(s, d):
    active = scoped(s, d).groupBy("project_id").agg(F.max("ts").alias("last_active"))
    return browse.identity_names_by_activity(A.projects(s, d), active)


_DAYS = f"WITH {A.MESSAGES}, {A.SESSIONS}, days AS (SELECT CAST(m.ts - INTERVAL 4 HOUR AS DATE) AS entry_date, m.session_id, s.project_id, max(m.id) AS latest_id, max(m.ts) AS latest FROM messages m JOIN sessions s USING (session_id) WHERE ts IS NOT NULL GROUP BY 1, 2, 3), groups AS (SELECT entry_date, project_id, list_sort(list(session_id)) AS session_ids, max(latest_id) AS latest_id, max(latest) AS latest FROM days GROUP BY 1, 2) "


def days(s, d):
    return journal.session_days(A.messages(s, d), A.sessions(s, d))


def groups(s, d):
    return journal.day_groups(days(s, d))


@query("a15_logical_days", _DAYS + "SELECT entry_date, session_id, project_id, latest_id FROM days")
def _(s, d):
    return days(s, d).drop("latest")


@query("a16_day_groups", _DAYS + "SELECT entry_date, project_id, array_to_string(session_ids, ',') AS session_ids, latest_id FROM groups")
def _(s, d):
    return groups(s, d).select("entry_date", "project_id", F.array_join(F.transform("session_ids", lambda x: x.cast("string")), ",").alias("session_ids"), "latest_id")


#: Journal entries over the groups: every third is missing, some name one session too few, some are old.
def entries(g: DataFrame) -> DataFrame:
    kept = g.where(F.col("latest_id") % 3 != 0)
    ids = F.when(F.col("latest_id") % 5 == 0, F.slice("session_ids", 2, 100_000)).otherwise(F.col("session_ids"))
    return kept.select("entry_date", "project_id", ids.alias("session_ids"), (F.col("latest_id") - F.when(F.col("latest_id") % 7 == 0, 1).otherwise(0)).alias("snapshot_id"))


_ENTRIES = ", entries AS (SELECT entry_date, project_id, CASE WHEN latest_id % 5 = 0 THEN session_ids[2:] ELSE session_ids END AS session_ids, latest_id - CASE WHEN latest_id % 7 = 0 THEN 1 ELSE 0 END AS snapshot_id FROM groups WHERE latest_id % 3 <> 0) "


@query("j06_pending", _DAYS + _ENTRIES + "SELECT * FROM (SELECT g.entry_date, g.project_id, CASE WHEN e.entry_date IS NULL THEN 'missing' WHEN g.session_ids <> e.session_ids THEN 'sessions' WHEN g.latest_id > e.snapshot_id THEN 'stale' END AS reason FROM groups g LEFT JOIN entries e USING (entry_date, project_id)) WHERE reason IS NOT NULL")
def _(s, d):
    g = groups(s, d)
    return journal.pending(g, entries(g))


@query("d09_provenance", _DAYS + _ENTRIES + "SELECT e.entry_date, e.project_id, e.session_ids = g.session_ids AS exact FROM entries e JOIN groups g USING (entry_date, project_id)")
def _(s, d):
    g = groups(s, d)
    return journal.provenance_ok(g, entries(g))


@query("o04_same_sets", _DAYS + _ENTRIES + "SELECT exact, count(*) AS n FROM (SELECT e.session_ids = g.session_ids AS exact FROM entries e JOIN groups g USING (entry_date, project_id)) GROUP BY 1")
def _(s, d):
    g = groups(s, d)
    return journal.provenance_ok(g, entries(g)).groupBy("exact").agg(F.count("*").alias("n"))


@query("j21_snapshot_visibility", _DAYS + _ENTRIES + "SELECT count(*) AS unseen FROM groups g JOIN entries e USING (entry_date, project_id) WHERE g.latest_id > e.snapshot_id")
def _(s, d):
    g = groups(s, d)
    e = entries(g).select("entry_date", "project_id", "snapshot_id")
    return g.join(e, ["entry_date", "project_id"]).where("latest_id > snapshot_id").agg(F.count("*").alias("unseen"))


_TICKS = "(SELECT o_orderdate AS tick_at FROM orders)"


def ticks(s, d):
    return A.table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("tick_at"))


@query("a17_journal_health", _DAYS + f"SELECT g.n AS groups, t.n AS ticks_last_day, CASE WHEN t.last IS NULL THEN 'no_tick' WHEN TIMESTAMP '2024-02-01' > g.latest + INTERVAL 12 HOUR THEN 'stale' ELSE 'ok' END AS status FROM (SELECT count(*) AS n, max(latest) AS latest FROM groups) g, (SELECT max(tick_at) AS last, count(*) FILTER (WHERE tick_at > TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR) AS n FROM {_TICKS}) t")
def _(s, d):
    return journal.health(groups(s, d), ticks(s, d), "2024-02-01 00:00:00", 12)


@query("a18_tick_summary", f"SELECT count(*) AS ticks, max(tick_at) AS newest, count(*) FILTER (WHERE tick_at > TIMESTAMP '1997-01-01' - INTERVAL 24 HOUR) AS later FROM {_TICKS}")
def _(s, d):
    out = ticks(s, d).agg(F.count("*").alias("ticks"), F.max("tick_at").alias("newest"), F.count(F.when(F.col("tick_at") > F.expr("timestamp'1997-01-01' - interval 24 hours"), 1)).alias("later"))
    return _plain_times(out, "newest")


@query("d10_retention", f"SELECT count(*) AS kept FROM {_TICKS} WHERE tick_at >= TIMESTAMP '1997-01-01' - INTERVAL 30 DAY")
def _(s, d):
    return ingest.retain(ticks(s, d), "1997-01-01 00:00:00").agg(F.count("*").alias("kept"))


@query("p20_freshness", f"WITH {A.scoped()}, seen AS (SELECT machine_id, max(m.ts) AS last_seen FROM messages m JOIN sessions USING (session_id) JOIN projects USING (project_id) GROUP BY 1), x AS (SELECT r_regionkey AS machine_id, r_name AS hostname, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_seen)) // 1000000 AS age_s FROM region LEFT JOIN seen ON machine_id = r_regionkey) SELECT *, coalesce(age_s > 172800 AND hostname NOT IN ('ASIA'), false) AS alert FROM x")
def _(s, d):
    seen = A.messages(s, d).join(A.sessions(s, d), "session_id").join(A.projects(s, d), "project_id")
    return journal.freshness(A.machines(s, d), seen, "2024-02-01 00:00:00", 172_800, ["ASIA"])


@query("a19_total_count", _WITH + "SELECT count(*) AS total FROM scope WHERE provider = 'click' AND role = 'user'")
def _(s, d):
    return scoped(s, d, provider="click").where("role = 'user'").agg(F.count("*").alias("total"))


@query("a20_session_comparison", _WITH + """, one AS (SELECT project_id, session_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(role) AS messages, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM scope WHERE usage_row GROUP BY 1, 2)
SELECT project_id, session_id, round(100.0 * tokens / sum(tokens) OVER w, 6) AS tokens_percent, round(100.0 * messages / sum(messages) OVER w, 6) AS messages_percent,
 CAST(row_number() OVER (PARTITION BY project_id ORDER BY tokens DESC, session_id) AS INTEGER) AS token_rank, CAST(row_number() OVER (PARTITION BY project_id ORDER BY span DESC, session_id) AS INTEGER) AS duration_rank,
 tokens > floor(sum(tokens) OVER w / count(*) OVER w) AS above_average FROM one WINDOW w AS (PARTITION BY project_id)""")
def _(s, d):
    return rollups.session_comparison(scoped(s, d))


@query("a21_desktop_daily", _WITH + "SELECT CAST(ts AS DATE) AS date, count(*) AS messages, count(DISTINCT session_id) AS sessions, CAST(coalesce(sum(tokens) FILTER (WHERE usage_row), 0) AS BIGINT) AS total_tokens, CAST(least(greatest(count(*) // 10, 1), 24) AS BIGINT) AS active_hours FROM scope WHERE ts IS NOT NULL GROUP BY 1")
def _(s, d):
    return board.desktop_daily(scoped(s, d))


@query("a22_desktop_tools", f"WITH {A.TOOL_USES} SELECT tool_name, count(*) AS uses, round(count(*) FILTER (WHERE NOT is_error) * 100.0 / count(*), 6) AS success_rate FROM tool_uses GROUP BY 1")
def _(s, d):
    return board.desktop_tools(A.tool_uses(s, d))


@query("a24_latest_edits", "SELECT l_partkey AS file_path, arg_max(l_orderkey * 100 + l_linenumber, (l_shipdate, l_orderkey * 100 + l_linenumber)) AS edit_id, max(l_shipdate) AS ts, count(*) AS edits FROM lineitem GROUP BY 1")
def _(s, d):
    e = A.table(s, d, "lineitem").select(F.col("l_partkey").alias("file_path"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edit_id"))
    return board.latest_per_file(e)


@query("a25_modal", "SELECT l_suppkey AS session_id, l_returnflag AS cwd, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1")
def _(s, d):
    rows = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.col("l_returnflag").alias("cwd"))
    return board.modal(rows, "session_id", "cwd")


@query("a26_session_metadata", """WITH x AS (SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), arg_min(text, turn) FILTER (WHERE role = 'assistant'), arg_max(text, turn)) AS s FROM conversations GROUP BY 1)
SELECT session_id, messages, user_messages, CASE WHEN length(s) > 100 THEN substr(s, 1, 97) || '...' ELSE s END AS summary FROM x""")
def _(s, d):
    return board.session_metadata(A.turns(s, d))


@query("a27_board_counters", f"WITH {A.TOOL_USES} SELECT session_id, count(*) AS uses, count(*) FILTER (WHERE is_error) AS errors, count(DISTINCT tool_name) AS tools, count(DISTINCT lower(tool_name) || coalesce(skill_name, '')) AS kinds FROM tool_uses GROUP BY 1")
def _(s, d):
    return board.board_counters(A.tool_uses(s, d), F.concat(F.lower("tool_name"), F.coalesce("skill_name", F.lit(""))))


@query("a28_board_base", _WITH + "SELECT session_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS rows FROM scope WHERE usage_row GROUP BY 1")
def _(s, d):
    return scoped(s, d).where("usage_row").groupBy("session_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("rows"))


_STREAK = "WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), runs AS (SELECT user_id, count(*) AS days, max(day) AS last_day FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days) GROUP BY user_id, island) "


@query("a29_streaks", _STREAK + "SELECT user_id, max(days) AS longest, arg_max(days, last_day) AS latest, max(last_day) AS last_day FROM runs GROUP BY 1")
def _(s, d):
    return sequences.streaks(A.table(s, d, "events").select("user_id", F.to_date("ts").alias("day")), "user_id")


_PER_DAY = "WITH days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM days), filled AS (SELECT day, coalesce(n, 0) AS n FROM cal LEFT JOIN days USING (day)) "


def _filled(s, d):
    rows = A.table(s, d, "events").where(F.col("event_type") == "purchase")
    return board.calendar(rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "n")


@query("a29_week_grid", _PER_DAY + "SELECT day, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS week, CAST(dayofweek(day) AS INTEGER) AS dow, round(n / (SELECT max(n) FROM filled), 6) AS intensity FROM filled")
def _(s, d):
    return board.week_grid(_filled(s, d), "n")


@query("a31_calendar_growth", _PER_DAY + "SELECT day, n, CAST(CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE round((n - p) * 100.0 / p) END AS BIGINT) AS growth_percent FROM (SELECT *, lag(n) OVER (ORDER BY day) AS p FROM filled)")
def _(s, d):
    return board.growth(_filled(s, d), "n")


_PRICES = [("m", 1.0, 2.0), ("m1", 3.0, 15.0), ("m2", 0.5, 1.5)]
_PRICED = f", u AS (SELECT model, {_MODEL} GROUP BY 1), prices(k, i, o) AS (VALUES ('m', 1.0, 2.0), ('m1', 3.0, 15.0), ('m2', 0.5, 1.5)), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY length(k) DESC NULLS LAST, k) AS r FROM u LEFT JOIN prices ON contains(model, k)) WHERE r = 1), costed AS (SELECT model, total_tokens, round((input_tokens * coalesce(CAST(i AS DOUBLE), 9) + output_tokens * coalesce(CAST(o AS DOUBLE), 9)) / 1e6, 6) AS cost, k IS NOT NULL AS priced FROM one) "


def _costed(s, d):
    prices = s.createDataFrame(_PRICES, "model string, input_rate double, output_rate double")
    return board.costs(rollups.models(scoped(s, d)), prices, {"input": 9.0, "output": 9.0})


@query("a30_costs", _WITH + _PRICED + "SELECT * FROM costed")
def _(s, d):
    return _costed(s, d)


@query("a30_coverage", _WITH + _PRICED + "SELECT round(sum(cost), 6) AS cost, round(coalesce(sum(total_tokens) FILTER (WHERE priced), 0) / greatest(coalesce(sum(total_tokens), 0), 1), 6) AS coverage FROM costed")
def _(s, d):
    return board.coverage(_costed(s, d))


@query("a32_session_metrics", _WITH + ", x AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM scope WHERE usage_row GROUP BY 1) SELECT session_id, CAST(round(tokens / n) AS BIGINT) AS tokens_per_message, span // 60000000 AS minutes, CAST(round(100 - row_number() OVER (ORDER BY tokens DESC, session_id) * 100.0 / count(*) OVER ()) AS BIGINT) AS percentile FROM x")
def _(s, d):
    x = scoped(s, d).where("usage_row").groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"))
    percentile = F.round(100 - F.col("place") * 100.0 / F.col("total")).cast("long")
    return board.token_ranks(x).select("session_id", F.round(F.col("tokens") / F.col("n")).cast("long").alias("tokens_per_message"), F.expr("span div 60000000").alias("minutes"), percentile.alias("percentile"))


@query("a34_directories", f"WITH {A.PROJECTS} SELECT regexp_replace(project_path, '/[^/]*$', '') AS directory, count(*) AS projects, min(project_name) AS first_project FROM projects GROUP BY 1")
def _(s, d):
    return browse.by_directory(A.projects(s, d))


@query("a35_disk_usage", "SELECT source AS archive, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1")
def _(s, d):
    return A.table(s, d, "documents").groupBy(F.col("source").alias("archive")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("size"))


@query("a36_scaled_share", "SELECT o_orderkey, (CAST(o_totalprice AS BIGINT) * 3 + 3) // 7 AS share FROM orders")
def _(s, d):
    price = F.bround("o_totalprice").cast("long")
    return A.table(s, d, "orders").select("o_orderkey", board.scaled_share(price, F.lit(3), F.lit(7)).alias("share"))


@query("a37_main_sessions", "SELECT session_id, messages FROM (SELECT user_id AS session_id, count(*) - count(*) FILTER (WHERE event_type = 'view') AS messages FROM events GROUP BY 1) WHERE messages > 0")
def _(s, d):
    side = F.count(F.when(F.col("event_type") == "view", 1))
    return A.table(s, d, "events").groupBy(F.col("user_id").alias("session_id")).agg((F.count("*") - side).alias("messages")).where("messages > 0")


# --- windows and ordered folds


@query("w01_active_minutes", _WITH + f", {_GAPS} SELECT provider, {_ACTIVE} AS active_minutes FROM gaps WHERE gap > 0 AND gap <= 36000 GROUP BY 1")
def _(s, d):
    return scope.active_minutes(scoped(s, d), ["provider"], 36_000)


@query("w02_positions", "SELECT conv_id AS session_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS position FROM conversations")
def _(s, d):
    out = browse.session_positions(A.turns(s, d), [F.asc_nulls_last("seq"), F.asc_nulls_last("text")])
    return out.select("session_id", "seq", F.col("position").cast("long").alias("position"))


@query("w03_usage_rows", f"WITH {A.MESSAGES} SELECT id, usage_row FROM messages")
def _(s, d):
    return A.messages(s, d).select("id", "usage_row")


@query("w04_top_per_kind", _TOOLS + "SELECT kind, name, uses FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY uses DESC, name) AS place FROM counted) WHERE place <= 3")
def _(s, d):
    return rollups.tool_usage(scoped(s, d), A.tool_uses(s, d), A.tool_results(s, d), top=3).select("kind", "name", "uses")


@query("w05_counter_deltas", "SELECT event_id, greatest(event_id % 1000 - coalesce(lag(event_id % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 0) AS total_delta FROM events")
def _(s, d):
    rows = A.table(s, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.col("event_id") % 1000).alias("total"))
    return sequences.counter_deltas(rows, ["total"], ["ts", "event_id"]).select("event_id", "total_delta")


@query("w06_streak_islands", _STREAK + "SELECT user_id, count(*) AS islands, max(days) AS longest FROM runs GROUP BY 1")
def _(s, d):
    days_ = A.table(s, d, "events").select(F.col("user_id"), F.to_date("ts").alias("day"))
    from pyspark.sql import Window

    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days_.distinct().withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("days"))
    return runs.groupBy("user_id").agg(F.count("*").alias("islands"), F.max("days").alias("longest"))


@query("w07_break_periods", """WITH g AS (SELECT user_id AS session_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 60000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
p AS (SELECT session_id, ts, sum(CASE WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS period FROM g)
SELECT session_id, CAST(sum(minutes) AS BIGINT) AS active_minutes, count(*) AS periods FROM (SELECT session_id, period, greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000) AS minutes FROM p GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    return sequences.break_periods(A.messages(s, d))


@query("w08_leader_groups", """WITH RECURSIVE o AS (SELECT user_id AS session_id, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT session_id, n, id, id AS leader, us AS since FROM o WHERE n = 1 UNION ALL SELECT o.session_id, o.n, o.id, CASE WHEN o.us - f.since > 7200000000 THEN o.id ELSE f.leader END, CASE WHEN o.us - f.since > 7200000000 THEN o.us ELSE f.since END FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
SELECT session_id, id, leader FROM f""")
def _(s, d):
    return sequences.leader_groups(A.messages(s, d), 7200)


@query("w10_runs", """WITH m AS (SELECT user_id AS session_id, event_type, event_id, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT session_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS provider, count(*) AS n FROM r GROUP BY 1, 2""")
def _(s, d):
    return sequences.runs_of_equal(A.messages(s, d), "provider", ["ts", "id"])


@query("w11_date_dividers", "SELECT id, session_id FROM (SELECT event_id AS id, user_id AS session_id, CAST(ts AS DATE) AS day, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR day <> before")
def _(s, d):
    return sequences.date_dividers(A.messages(s, d).withColumn("ts_local", F.col("ts")), ["ts", "id"]).select("id", "session_id")


@query("w12_tree_depths", """WITH RECURSIVE e AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 64 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 3 - 1 END AS parent FROM (SELECT DISTINCT o_orderkey FROM orders)),
t AS (SELECT node, node AS root, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, t.root, t.depth + 1 FROM t JOIN e ON e.parent = t.node WHERE t.depth < 64) SELECT * FROM t""")
def _(s, d):
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("node")).distinct()
    return sequences.tree_depths(o.select("node", F.when(F.col("node") % 64 != 0, F.col("node") - F.col("node") % 3 - 1).alias("parent")))


@query("w15_tail_page", "SELECT session_id, seq, text FROM (SELECT conv_id AS session_id, turn AS seq, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE place > total - 1 - 2 AND place <= total - 1")
def _(s, d):
    return browse.tail_page(A.turns(s, d), 1, 2).select("session_id", "seq", "text")


# --- joins


@query("j01_message_join", f"WITH {A.scoped()} SELECT m.id, p.project_name, r.r_name AS hostname FROM messages m JOIN sessions s USING (session_id) LEFT JOIN projects p USING (project_id) JOIN region r ON r.r_regionkey = p.machine_id")
def _(s, d):
    return scoped(s, d).join(A.machines(s, d), "machine_id").select("id", "project_name", "hostname")


@query("j03_zone_join", f"WITH {A.MESSAGES} SELECT id, CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS INTEGER) AS hour FROM messages")
def _(s, d):
    return A.messages(s, d).select("id", F.hour(F.from_utc_timestamp("ts", "America/New_York")).alias("hour"))


@query("j04_outcomes", f"WITH {A.TOOL_USES}, {A.TOOL_RESULTS}, o AS (SELECT session_id, tool_use_id, bool_or(is_error) AS failed FROM tool_results GROUP BY 1, 2) SELECT coalesce(o.failed, u.is_error, false) AS failed, count(*) AS n FROM tool_uses u LEFT JOIN o USING (session_id, tool_use_id) GROUP BY 1")
def _(s, d):
    u = A.tool_uses(s, d).join(rollups.outcomes(A.tool_results(s, d)), ["session_id", "tool_use_id"], "left")
    return u.groupBy(F.coalesce("failed", "is_error", F.lit(False)).alias("failed")).agg(F.count("*").alias("n"))


def _aliases(s):
    return s.createDataFrame([("EUROPE/FRANCE", "ASIA"), ("AFRICA/KENYA", "ASIA")], "project_path string, identity_key string")


_PATHS = "aliases(project_path, identity_key) AS (VALUES ('EUROPE/FRANCE', 'ASIA'), ('AFRICA/KENYA', 'ASIA')), paths AS (SELECT project_path FROM projects WHERE identity_key = 'ASIA' GROUP BY 1 HAVING NOT bool_and(git_worktree) UNION SELECT project_path FROM aliases WHERE identity_key = 'ASIA')"


@query("o01_identity_paths", f"WITH {A.PROJECTS}, {_PATHS} SELECT project_path FROM paths")
def _(s, d):
    return browse.identity_paths(A.projects(s, d), _aliases(s), "ASIA", worktrees=False)


@query("p03_identity_scope", _WITH + f", {_PATHS} SELECT count(*) AS n, CAST(sum(tokens) FILTER (WHERE usage_row) AS BIGINT) AS tokens FROM scope WHERE project_path IN (SELECT project_path FROM paths)")
def _(s, d):
    paths = browse.identity_paths(A.projects(s, d), _aliases(s), "ASIA", worktrees=False)
    return scoped(s, d, paths=paths).agg(F.count("*").alias("n"), F.sum(F.when(F.col("usage_row"), F.col("tokens"))).alias("tokens"))


@query("j10_orphans", f"WITH {A.SESSIONS}, {A.PROJECTS}, {_PATHS} SELECT DISTINCT project_path FROM sessions JOIN projects USING (project_id) WHERE git_worktree AND project_path NOT IN (SELECT project_path FROM aliases)")
def _(s, d):
    return browse.orphans(A.sessions(s, d), A.projects(s, d), _aliases(s))


@query("j15_latest_before", """SELECT r.user_id, r.event_id AS pos, max(u.event_id) AS use_pos FROM events r LEFT JOIN events u ON u.user_id = r.user_id AND u.event_type = 'click' AND u.event_id < r.event_id WHERE r.event_type = 'purchase' GROUP BY 1, 2""")
def _(s, d):
    e = A.table(s, d, "events").select("user_id", F.col("event_id").alias("pos"), "event_type")
    return sequences.latest_before(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"), ["user_id"])


@query("j08_commit_range", """WITH ss AS (SELECT user_id AS session_id, user_id % 25 AS project_id, min(ts) - INTERVAL 5 MINUTE AS lo, min(ts) + INTERVAL 2 DAY + INTERVAL 5 MINUTE AS hi FROM events GROUP BY 1, 2)
SELECT session_id, event_id AS commit_id FROM ss JOIN events ON user_id % 25 = project_id AND event_type = 'purchase' AND ts BETWEEN lo AND hi""")
def _(s, d):
    m = A.messages(s, d)
    ss = m.groupBy("session_id").agg(F.min("ts").alias("first_message_time")).withColumn("project_id", F.col("session_id") % 25).withColumn("last_message_time", F.col("first_message_time") + F.expr("interval 2 days"))
    commits = m.where("provider = 'purchase'").select(F.col("id").alias("commit_id"), (F.col("session_id") % 25).alias("project_id"), F.col("ts").alias("committed_at"))
    return board.near_commits(ss, commits)


@query("j18_worktrees", f"WITH {A.PROJECTS}, m AS (SELECT regexp_replace(project_path, '/[^/]*$', '') AS parent, min(project_path) AS main_path FROM projects WHERE NOT git_worktree GROUP BY 1) SELECT project_path, main_path FROM projects LEFT JOIN m ON parent = regexp_replace(project_path, '/[^/]*$', '') WHERE git_worktree")
def _(s, d):
    return browse.pair_worktrees(A.projects(s, d))


@query("j13_fan_out", f"WITH {A.TOOL_USES}, k AS (SELECT 'tool' AS kind, tool_name AS name FROM tool_uses UNION ALL SELECT 'skill', skill_name FROM tool_uses UNION ALL SELECT 'subagent', subagent_type FROM tool_uses) SELECT kind, count(name) AS named, count(*) AS n FROM k GROUP BY 1")
def _(s, d):
    return A.tool_uses(s, d).select(F.expr("stack(3, 'tool', tool_name, 'skill', skill_name, 'subagent', subagent_type) as (kind, name)")).groupBy("kind").agg(F.count("name").alias("named"), F.count("*").alias("n"))


# --- filters, sorts, pages


@query("p05_instants", f"WITH {A.MESSAGES} SELECT count(*) AS n FROM messages WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
def _(s, d):
    return browse.between_instants(A.messages(s, d), "2024-01-05 00:00:00", "2024-01-07 00:00:00", inclusive=True).agg(F.count("*").alias("n"))


@query("p06_half_open", f"WITH {A.MESSAGES} SELECT count(*) AS n FROM messages WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
def _(s, d):
    return browse.between_instants(A.messages(s, d), "2024-01-05 00:00:00", "2024-01-07 00:00:00").agg(F.count("*").alias("n"))


@query("p07_local_dates", _WITH + "SELECT count(*) AS n, CAST(sum(tokens) FILTER (WHERE usage_row) AS BIGINT) AS tokens FROM scope WHERE CAST(ts_local AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def _(s, d):
    w = scope.StatsWindow("2024-01-05", "2024-01-07", "Europe/Rome")
    return scoped(s, d, w).agg(F.count("*").alias("n"), F.sum(F.when(F.col("usage_row"), F.col("tokens"))).alias("tokens"))


@query("p08_day_pushdown", "SELECT count(*) AS n FROM events WHERE CAST(ts - INTERVAL 4 HOUR AS DATE) >= DATE '2024-01-20'")
def _(s, d):
    return journal.since_day(A.messages(s, d), "2024-01-20").agg(F.count("*").alias("n"))


@query("p09_stats_mode", "SELECT provider, count(*) FILTER (WHERE kind IN ('user', 'assistant') AND NOT side AND NOT made_up) AS conversation, count(*) FILTER (WHERE CASE WHEN made_up OR kind = 'summary' THEN false WHEN kind IN ('user', 'assistant', 'system') THEN true ELSE used END) AS billing FROM (SELECT *, provider = 'antigravity' AND kind = 'user' AND NOT used AS made_up FROM (SELECT list_extract(['user', 'assistant', 'system', 'summary', 'progress', 'queue-operation', 'other'], CAST(event_id % 7 AS INTEGER) + 1) AS kind, event_id % 5 = 0 AS side, event_id % 3 = 0 AS used, CASE WHEN user_id % 2 = 0 THEN 'antigravity' ELSE 'claude' END AS provider FROM events)) GROUP BY 1")
def _(s, d):
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("user", "assistant", "system", "summary", "progress", "queue-operation", "other")]), (i % 7).cast("int") + 1)
    m = A.table(s, d, "events").select(kind.alias("kind"), (i % 5 == 0).alias("is_sidechain"), (i % 3 == 0).alias("has_usage"), F.when(F.col("user_id") % 2 == 0, "antigravity").otherwise("claude").alias("provider"))
    return m.groupBy("provider").agg(*[F.count(F.when(board.stats_mode(mode), 1)).alias(name) for mode, name in (("conversation_only", "conversation"), ("billing_total", "billing"))])


@query("p14_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def _(s, d):
    return A.table(s, d, "documents").where(T.contains_ascii_ci(F.col("text"), "LICENSE")).select("doc_id")


@query("p19_expiring", "WITH x AS (SELECT o_orderkey AS session_id, (epoch_us(TIMESTAMP '1998-08-01') - epoch_us(o_orderdate)) // 86400000000 AS age_days FROM orders) SELECT session_id, age_days, greatest(300 - age_days, 0) AS days_remaining FROM x WHERE age_days >= 270")
def _(s, d):
    a = A.table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return board.expiring(a, "1998-08-01 00:00:00", 300, 30)


@query("p22_glob", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*a.e.*')")
def _(s, d):
    return A.table(s, d, "part").where(F.col("p_name").rlike(T.glob_regex("*a?e*"))).select("p_partkey")


@query("p01_optional_filters", _WITH + "SELECT id, ts FROM scope WHERE provider = 'view' ORDER BY ts NULLS LAST, id LIMIT 20 OFFSET 10")
def _(s, d):
    out = browse.browse(scoped(s, d), [F.asc_nulls_last("ts"), F.asc_nulls_last("id")], 20, 10, provider="view", role=None)
    return _plain_times(out.select("id", "ts"), "ts")


@query("p02_project_filter", _WITH + "SELECT count(*) AS n FROM scope WHERE project_name = (SELECT min(n_name) FROM nation)")
def _(s, d):
    name = A.table(s, d, "nation").agg(F.min("n_name")).first()[0]
    return browse.in_project(scoped(s, d), name).agg(F.count("*").alias("n"))


@query("l02_project_order", f"WITH {A.scoped()}, x AS (SELECT p.project_id, max(m.ts) AS last_modified FROM projects p LEFT JOIN sessions USING (project_id) LEFT JOIN messages m USING (session_id) GROUP BY 1) SELECT project_id FROM x ORDER BY last_modified DESC NULLS LAST, project_id DESC LIMIT 7")
def _(s, d):
    x = A.projects(s, d).join(A.sessions(s, d), "project_id", "left").join(A.messages(s, d), "session_id", "left").groupBy("project_id").agg(F.max("ts").alias("last_modified"))
    return browse.browse(x, [F.desc_nulls_last("last_modified"), F.desc("project_id")], 7).select("project_id")


@query("l08_top_k", _WITH + "SELECT id, tokens FROM scope ORDER BY tokens DESC, id LIMIT 25")
def _(s, d):
    return scoped(s, d).orderBy(F.desc("tokens"), "id").limit(25).select("id", "tokens")


@query("o02_union", "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind, text FROM documents UNION ALL SELECT 'turn', text FROM conversations UNION ALL SELECT 'item', text FROM benchmark) GROUP BY 1")
def _(s, d):
    part = lambda n, k: A.table(s, d, n).select(F.lit(k).alias("kind"), "text")
    return part("documents", "doc").unionByName(part("conversations", "turn")).unionByName(part("benchmark", "item")).groupBy("kind").agg(F.count("*").alias("n"))


# --- search


def _docs(s, d):
    return A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


_TOKS = "WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS toks FROM documents), "


@query("g01_keyword", _TOKS + "h AS (SELECT id, ' ' || array_to_string(toks, ' ') || ' ' AS said, toks FROM t) SELECT id, round(len(list_filter(toks, lambda x: x IN ('license', 'version'))) / (1 + ln(1.0 + len(toks))), 6) AS rank FROM h WHERE contains(said, ' license') AND contains(said, ' version') ORDER BY rank DESC, id DESC LIMIT 50")
def _(s, d):
    return search.keyword(_docs(s, d), "license version").select("id", "rank")


@query("f09_web_search", _TOKS + "h AS (SELECT id, ' ' || array_to_string(toks, ' ') || ' ' AS said FROM t) SELECT id FROM h WHERE contains(said, ' apache license ') AND NOT contains(said, ' gnu ') OR contains(said, ' public license ')")
def _(s, d):
    q = T.parse_query('"apache license" -gnu OR "public license"')
    return _docs(s, d).where(T.matches(T.tokens(F.col("text")), q)).select("id")


@query("g01_postings", _TOKS + "p AS (SELECT id, len(toks) AS length, unnest(toks) AS token FROM t), h AS (SELECT id, length, count(*) AS tf, count(DISTINCT token) AS w FROM p WHERE token IN ('license', 'version') GROUP BY 1, 2) SELECT id, round(tf / (1 + ln(1.0 + length)), 6) AS rank FROM h WHERE w = 2 ORDER BY rank DESC, id DESC LIMIT 50")
def _(s, d):
    return search.by_postings(search.postings(_docs(s, d)), ["license", "version"])


_COS = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, q) "


def _near(s, d, limit=50):
    e = A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.semantic(e, e.where("id = 0").select(F.col("embedding").alias("q")), limit)


@query("g03_semantic", _COS + "SELECT id, similarity FROM v ORDER BY similarity DESC, id DESC LIMIT 50")
def _(s, d):
    return _near(s, d)


@query("g04_hybrid", _COS + ", s AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id DESC) AS place FROM (SELECT * FROM v ORDER BY similarity DESC, id DESC LIMIT 50)), k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS place FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 50)) SELECT id, round(coalesce(1.0::DOUBLE / (60 + k.place), 0) + coalesce(1.0::DOUBLE / (60 + s.place), 0), 9) AS score FROM k FULL JOIN s USING (id) ORDER BY score DESC, id DESC LIMIT 20")
def _(s, d):
    long = A.table(s, d, "documents").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(50).select(F.col("doc_id").alias("id"), "n_chars")
    return search.fuse(search.placed(long, [F.desc("n_chars"), F.desc("id")]), search.placed(_near(s, d), [F.desc("similarity"), F.desc("id")]))


@query("g07_matches", "SELECT doc_id AS id, CAST(unnest(generate_series(1, (length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7)) AS INTEGER) AS match FROM documents")
def _(s, d):
    return search.match_positions(_docs(s, d), "license").select("id", "match")


# --- scalar functions


@query("f12_cosine", _COS + "SELECT id, similarity FROM v")
def _(s, d):
    e = A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.cosines(e, e.where("id = 0").select(F.col("embedding").alias("q")))


@query("f13_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM embeddings")
def _(s, d):
    e = F.col("embedding")
    n = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return A.table(s, d, "embeddings").select("vec_id", F.round(n * F.sqrt(V.dot(V.normalize(e), V.normalize(e))), 5).alias("norm"))


@query("f16_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("f25_basename", "SELECT page_id, regexp_extract(url, '([^/\\\\]+)[/\\\\]*$', 1) AS base FROM pages")
def _(s, d):
    return A.table(s, d, "pages").select("page_id", T.basename(F.col("url")).alias("base"))


@query("f24_identity_key", "SELECT n_nationkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'g:' || a || '|' || b WHEN a IS NOT NULL THEN 'g:' || a WHEN b IS NOT NULL THEN 'r:' || b END AS identity_key FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'remote' || n_regionkey END AS b FROM nation)")
def _(s, d):
    n = A.table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("remote"), F.col("n_regionkey").cast("string"))).alias("b"))
    return n.select("n_nationkey", browse.identity_key("a", "b").alias("identity_key"))


@query("f33_occurrences", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS INTEGER) AS n FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", T.occurrences(F.col("text"), "The").alias("n"))


@query("d19_clamp_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE left(text, list_max(list_filter(range(40, 201), lambda i: strlen(left(text, i)) <= 200))) END AS clamped FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", T.clamp_bytes(F.col("text"), 200).alias("clamped"))


# --- ingest


def _stored(s, d, late: bool):
    e = A.table(s, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 4000).cast("string").alias("message_key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return e.where("id >= 6000" if late else "id < 6000")


@query("d04_insert_ignore", "WITH a AS (SELECT DISTINCT user_id, event_id % 4000 AS k FROM events WHERE event_id < 6000), b AS (SELECT DISTINCT user_id, event_id % 4000 AS k FROM events WHERE event_id >= 6000) SELECT user_id AS session_id, CAST(k AS VARCHAR) AS message_key FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.k = b.k)")
def _(s, d):
    sessions = A.table(s, d, "events").select(F.col("user_id").alias("session_id")).distinct()
    return ingest.new_messages(_stored(s, d, False), _stored(s, d, True), sessions).select("session_id", "message_key")


_STORED = "a AS (SELECT user_id AS session_id, count(*) AS message_count, min(ts) AS first_message_time, max(ts) AS last_message_time FROM events WHERE event_id < 6000 GROUP BY 1)"


def _stored_sessions(s, d):
    return _stored(s, d, False).groupBy("session_id").agg(F.count("*").alias("message_count"), F.min("ts").alias("first_message_time"), F.max("ts").alias("last_message_time"))


@query("d06_session_deltas", f"WITH {_STORED}, b AS (SELECT user_id AS session_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_id >= 6000 GROUP BY 1) SELECT session_id, message_count + coalesce(n, 0) AS message_count, least(first_message_time, lo) AS first_message_time, greatest(last_message_time, hi) AS last_message_time FROM a LEFT JOIN b USING (session_id)")
def _(s, d):
    return _plain_times(ingest.session_deltas(_stored_sessions(s, d), _stored(s, d, True)), "first_message_time", "last_message_time")


@query("d07_project_rollup", f"WITH {_STORED} SELECT CAST(session_id % 25 AS INTEGER) AS project_id, count(*) AS session_count, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS message_count FROM a GROUP BY 1")
def _(s, d):
    return ingest.project_rollup(_stored_sessions(s, d).withColumn("project_id", (F.col("session_id") % 25).cast("int")))


@query("d08_reconcile", f"WITH {_STORED}, r AS (SELECT user_id AS session_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1) SELECT session_id, n AS message_count, lo AS first_message_time, hi AS last_message_time FROM a JOIN r USING (session_id) WHERE n <> message_count OR lo <> first_message_time OR hi <> last_message_time")
def _(s, d):
    every = _stored(s, d, False).unionByName(_stored(s, d, True))
    return _plain_times(ingest.reconcile(_stored_sessions(s, d), every), "first_message_time", "last_message_time")


@query("d13_stale_embeddings", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def _(s, d):
    docs = _docs(s, d)
    old = docs.where("id % 3 <> 0").select("id", F.sha2(F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("content_hash"))
    return ingest.stale_embeddings(docs, old).select("id")


@query("d16_markdown", "SELECT conv_id AS session_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def _(s, d):
    return ingest.export_markdown(A.turns(s, d))


@query("t16_day_windows", "SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    w = F.window("ts", "1 day", "1 day", "4 hours")
    return A.messages(s, d).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


@query("t17_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS new FROM events), p AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS w FROM g) SELECT user_id AS session_id, min(ts) AS start, count(*) AS n FROM p GROUP BY user_id, w""")
def _(s, d):
    w = F.session_window("ts", "120 minutes")
    return _plain_times(A.messages(s, d).groupBy("session_id", w.alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), "n"), "start")


# --- queries over stores' own tables (session lists, key-value stores)


@query("q01_by_directory", "SELECT coalesce(nullif(c_mktsegment, ''), 'unknown') AS working_dir, count(DISTINCT c_custkey) AS sessions, count(o_orderkey) AS messages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    c, o = A.table(s, d, "customer"), A.table(s, d, "orders").groupBy(F.col("o_custkey")).agg(F.count("*").alias("n"))
    rows = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("unknown")).alias("working_dir")).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


@query("q02_session_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS messages FROM customer")
def _(s, d):
    o = A.table(s, d, "orders").groupBy(F.col("o_custkey")).agg(F.count("*").alias("n"))
    return A.table(s, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("messages"))


@query("q05_null_bucket", "SELECT count(DISTINCT k) + max(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS conversations FROM (SELECT nullif(user_id % 50, 0) AS k FROM events)")
def _(s, d):
    k = F.nullif(F.col("user_id") % 50, F.lit(0))
    return A.table(s, d, "events").select(k.alias("k")).agg((F.countDistinct("k") + F.max(F.isnull("k").cast("int"))).alias("conversations"))


@query("q06_conversation_bounds", "SELECT nullif(user_id % 50, 0) AS k, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def _(s, d):
    return A.table(s, d, "events").groupBy(F.nullif(F.col("user_id") % 50, F.lit(0)).alias("k")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("q08_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(s, d):
    return A.table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("q09_key_prefix", "SELECT p_brand, max(p_name) AS p_name FROM part WHERE starts_with(p_type, 'S') OR starts_with(p_type, 'P') GROUP BY 1")
def _(s, d):
    p = A.table(s, d, "part").where(F.col("p_type").startswith("S") | F.col("p_type").startswith("P"))
    return p.groupBy("p_brand").agg(F.max("p_name").alias("p_name"))
