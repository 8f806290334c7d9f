"""Further queries: joins of sessions and entries, filters, orders, upserts, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators import board, browse, ingest, journal, search, sequences
from convolake.streaming import refresh

from . import adapters as A
from .catalogue import _DAYS, _ENTRIES, _TOKS, _WITH, _docs, _plain_times, entries, groups, query, scoped

_M = f"WITH {A.MESSAGES} "


@query("a33_uncontested_groups", f"WITH {A.PROJECTS}, own AS (SELECT project_name, count(DISTINCT identity_key) AS n, min(identity_key) AS k FROM projects GROUP BY 1) SELECT p.project_path, CASE WHEN n = 1 THEN k ELSE 'path:' || project_path END AS grp FROM projects p JOIN own USING (project_name)")
def _(s, d):
    p = A.projects(s, d)
    own = p.groupBy("project_name").agg(F.countDistinct("identity_key").alias("n"), F.min("identity_key").alias("k"))
    return p.join(own, "project_name").select("project_path", F.when(F.col("n") == 1, F.col("k")).otherwise(F.concat(F.lit("path:"), "project_path")).alias("grp"))


@query("a38_project_scan", "SELECT c_nationkey AS directory, count(*) AS files, CAST(sum(n) AS BIGINT) AS messages, coalesce(arg_max(c_name, (mtime, c_custkey)) FILTER (WHERE c_custkey % 2 = 0), arg_max(c_name, (mtime, c_custkey))) AS cwd FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS mtime FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    o = A.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("mtime"))
    rows = A.table(s, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"))
    newest = F.struct("mtime", "c_custkey")
    direct = F.max_by(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, newest))
    return rows.groupBy(F.col("c_nationkey").alias("directory")).agg(F.count("*").alias("files"), F.sum("n").alias("messages"), F.coalesce(direct, F.max_by("c_name", newest)).alias("cwd"))


@query("a39_state_merge", "WITH newest AS (SELECT o_custkey, arg_max(CAST(round(o_totalprice) AS BIGINT), (o_orderdate, o_orderkey)) AS reported, count(*) AS parts FROM orders GROUP BY 1) SELECT o_custkey AS session_id, greatest(reported, parts * 1000) AS total FROM newest")
def _(s, d):
    o = A.table(s, d, "orders").groupBy("o_custkey").agg(F.max_by(F.round("o_totalprice").cast("long"), F.struct("o_orderdate", "o_orderkey")).alias("reported"), F.count("*").alias("parts"))
    return o.select(F.col("o_custkey").alias("session_id"), F.greatest("reported", F.col("parts") * 1000).alias("total"))


@query("j02_last_seen", f"WITH {A.scoped()} SELECT r_regionkey AS machine_id, r_name AS hostname, max(m.ts) AS last_seen FROM region LEFT JOIN projects p ON p.machine_id = r_regionkey LEFT JOIN sessions s USING (project_id) LEFT JOIN messages m USING (session_id) GROUP BY 1, 2")
def _(s, d):
    seen = A.messages(s, d).join(A.sessions(s, d), "session_id").join(A.projects(s, d), "project_id").groupBy("machine_id").agg(F.max("ts").alias("last_seen"))
    return _plain_times(A.machines(s, d).join(seen, "machine_id", "left"), "last_seen")


@query("j05_semi_scope", f"WITH {A.scoped()} SELECT count(*) AS n FROM scope WHERE project_path IN (SELECT project_path FROM projects WHERE git_worktree)")
def _(s, d):
    return scoped(s, d, paths=A.projects(s, d).where("git_worktree").select("project_path")).agg(F.count("*").alias("n"))


@query("j07_entries_with_new_rows", _DAYS + _ENTRIES + ", ids AS (SELECT entry_date, project_id, snapshot_id, unnest(session_ids) AS session_id FROM entries) SELECT DISTINCT entry_date, project_id FROM ids i JOIN messages m ON m.session_id = i.session_id AND m.ts >= i.entry_date + INTERVAL 4 HOUR AND m.ts < i.entry_date + INTERVAL 28 HOUR AND m.id > i.snapshot_id")
def _(s, d):
    ids = entries(groups(s, d)).select("entry_date", "project_id", "snapshot_id", F.explode("session_ids").alias("session_id"))
    # the day of a row is an equi-key, so the join is no range join
    rows = A.messages(s, d).select("session_id", journal.logical_day().alias("entry_date"), "id")
    return ids.join(rows, ["session_id", "entry_date"]).where("id > snapshot_id").select("entry_date", "project_id").distinct()


@query("j09_span_overlap", "WITH x AS (SELECT user_id AS session_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT session_id FROM x WHERE lo < TIMESTAMP '2024-01-03' AND hi >= TIMESTAMP '2024-01-02'")
def _(s, d):
    x = A.messages(s, d).where("provider = 'purchase'").groupBy("session_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return x.where("lo < timestamp'2024-01-03' and hi >= timestamp'2024-01-02'").select("session_id")


@query("j11_earlier_row_anti", _M + "SELECT id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages o WHERE o.session_id = m.session_id AND o.group_key = m.group_key AND o.id < m.id)")
def _(s, d):
    return A.messages(s, d).where("usage_row").select("id")


@query("j12_preceding_count", "SELECT c.conv_id AS session_id, c.turn AS seq, (SELECT count(*) FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn < c.turn) AS position FROM conversations c")
def _(s, d):
    w = Window.partitionBy("session_id").orderBy("seq")
    return A.turns(s, d).select("session_id", "seq", (F.rank().over(w) - 1).cast("long").alias("position"))


@query("j14_one_row_always", "SELECT count(*) AS n, max(o_orderdate) AS newest FROM orders WHERE o_orderkey < 0")
def _(s, d):
    return A.table(s, d, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))


@query("j16_cause_join", "SELECT a.event_id, b.event_id AS observation FROM events a LEFT JOIN events b ON b.event_id // 2 = a.event_id AND b.event_id % 2 = 1 WHERE a.event_type = 'click'")
def _(s, d):
    e = A.table(s, d, "events")
    b = e.where("event_id % 2 = 1").select(F.col("event_id").alias("observation"), F.expr("event_id div 2").alias("cause"))
    return e.where("event_type = 'click'").join(b, F.col("event_id") == F.col("cause"), "left").select("event_id", "observation")


_SUMMARY = "s AS (SELECT o_orderkey AS id, o_custkey AS session_id, o_orderdate AS tm, CASE WHEN o_orderkey % 4 = 0 THEN 'sum' || o_orderkey END AS summary FROM orders)"


@query("j19_summary_propagation", f"WITH {_SUMMARY}, o AS (SELECT session_id, arg_min(summary, (tm, id)) AS oldest FROM s WHERE summary IS NOT NULL GROUP BY 1) SELECT id, coalesce(summary, oldest) AS summary FROM s LEFT JOIN o USING (session_id)")
def _(s, d):
    rows = A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("sum"), F.col("o_orderkey").cast("string"))).alias("summary"))
    oldest = rows.where("summary is not null").groupBy("session_id").agg(F.min_by("summary", F.struct("at", "id")).alias("oldest"))
    return rows.join(oldest, "session_id", "left").select("id", F.coalesce("summary", "oldest").alias("summary"))


@query("j20_merged_output", "SELECT a.conv_id AS session_id, a.turn AS seq, a.text || CASE WHEN b.text IS NULL THEN '' ELSE chr(10) || b.text END AS text FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def _(s, d):
    t = A.turns(s, d)
    answer = t.where("role = 'assistant'").select("session_id", (F.col("seq") - 1).alias("seq"), F.col("text").alias("answer"))
    return t.where("role = 'user'").join(answer, ["session_id", "seq"], "left").select("session_id", "seq", F.concat_ws("\n", "text", "answer").alias("text"))


@query("w09_gap_groups", """WITH g AS (SELECT user_id AS session_id, event_id AS id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new, ts FROM events)
SELECT session_id, id, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM g""")
def _(s, d):
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    new = F.coalesce((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > 3_600_000_000).cast("int"), F.lit(0))
    rows = A.messages(s, d).select("session_id", "id", "ts", new.alias("new"))
    return rows.select("session_id", "id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("grp"))


@query("w13_hidden_runs", """WITH m AS (SELECT user_id AS session_id, event_id, ts, event_type = 'error' AS hidden, CASE WHEN (event_type = 'error') = lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT session_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM r WHERE hidden GROUP BY 1, 2""")
def _(s, d):
    rows = A.messages(s, d).withColumn("hidden", F.col("provider") == "error")
    return sequences.runs_of_equal(rows, "hidden", ["ts", "id"]).where("hidden").select("session_id", "run", "n")


@query("w14_ranks", _WITH + ", x AS (SELECT provider, session_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM scope WHERE usage_row GROUP BY 1, 2) SELECT provider, session_id, CAST(row_number() OVER (PARTITION BY provider ORDER BY tokens DESC, session_id) AS INTEGER) AS place FROM x")
def _(s, d):
    x = scoped(s, d).where("usage_row").groupBy("provider", "session_id").agg(F.sum("tokens").alias("tokens"))
    return x.select("provider", "session_id", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("tokens"), "session_id")).alias("place"))


@query("p10_synthetic_prompts", _M + "SELECT count(*) AS n FROM messages WHERE NOT (provider = 'view' AND role = 'user' AND input_tokens = 0)")
def _(s, d):
    return A.messages(s, d).where(~((F.col("provider") == "view") & F.coalesce(F.col("role") == "user", F.lit(False)) & (F.col("input_tokens") == 0))).agg(F.count("*").alias("n"))


@query("p12_visible", _M + "SELECT id FROM messages WHERE role IS NOT NULL AND provider NOT IN ('signup')")
def _(s, d):
    return A.messages(s, d).where("role is not null and provider not in ('signup')").select("id")


@query("p13_search_filters", _WITH + "SELECT id FROM scope WHERE role = 'user' AND project_name IN (SELECT n_name FROM nation WHERE n_nationkey < 5) AND ts >= TIMESTAMP '2024-01-10'")
def _(s, d):
    names = A.table(s, d, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("project_name"))
    return browse.between_instants(scoped(s, d).where("role = 'user'"), "2024-01-10 00:00:00").join(names, "project_name", "left_semi").select("id")


@query("p15_role_and_kind", _M + "SELECT role, provider, count(*) AS n FROM messages WHERE role IN ('user', 'assistant') AND provider IN ('click', 'view') GROUP BY 1, 2")
def _(s, d):
    m = A.messages(s, d).where(F.col("role").isin("user", "assistant") & F.col("provider").isin("click", "view"))
    return m.groupBy("role", "provider").agg(F.count("*").alias("n"))


@query("p16_brushes", _M + "SELECT count(*) FILTER (WHERE contains(lower(model), 'm1')) AS model_hits, count(*) FILTER (WHERE provider = 'error') AS status_hits FROM messages")
def _(s, d):
    return A.messages(s, d).agg(F.count(F.when(F.contains(F.lower("model"), F.lit("m1")), 1)).alias("model_hits"), F.count(F.when(F.col("provider") == "error", 1)).alias("status_hits"))


@query("p23_main_and_sub", "SELECT contains(url, '/1') AS sub, count(*) AS n FROM pages GROUP BY 1")
def _(s, d):
    return A.table(s, d, "pages").groupBy(F.contains("url", F.lit("/1")).alias("sub")).agg(F.count("*").alias("n"))


@query("l03_session_order", "SELECT user_id AS session_id FROM events GROUP BY 1 ORDER BY max(ts) DESC NULLS LAST, 1 DESC LIMIT 15")
def _(s, d):
    x = A.messages(s, d).groupBy("session_id").agg(F.max("ts").alias("last"))
    return browse.browse(x, [F.desc_nulls_last("last"), F.desc("session_id")], 15).select("session_id")


@query("l04_message_order", _M + "SELECT id FROM messages WHERE session_id = 7 ORDER BY ts NULLS LAST, id LIMIT 30")
def _(s, d):
    return browse.browse(A.messages(s, d), [F.asc_nulls_last("ts"), F.asc_nulls_last("id")], 30, session_id=7).select("id")


@query("l06_journal_order", _DAYS + "SELECT entry_date, project_id FROM groups ORDER BY entry_date DESC, project_id DESC LIMIT 20")
def _(s, d):
    return browse.browse(groups(s, d), [F.desc("entry_date"), F.desc("project_id")], 20).select("entry_date", "project_id")


@query("l09_merge_order", "SELECT id FROM (SELECT doc_id AS id, TRY_CAST('2024-01-' || (doc_id % 40) AS DATE) AS d, '2024-01-' || (doc_id % 40) AS s FROM documents) ORDER BY d DESC NULLS LAST, s DESC, id LIMIT 40")
def _(s, d):
    said = F.concat(F.lit("2024-01-"), (F.col("doc_id") % 40).cast("string"))
    rows = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), said.alias("s")).withColumn("d", F.col("s").try_cast("date"))
    return rows.orderBy(F.desc_nulls_last("d"), F.desc("s"), "id").limit(40).select("id")


@query("l11_match_order", "SELECT doc_id AS id, CAST(m AS INTEGER) AS match FROM (SELECT doc_id, unnest(generate_series(1, (length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7)) AS m FROM documents) ORDER BY id DESC, match DESC LIMIT 25")
def _(s, d):
    return search.match_positions(_docs(s, d), "license").select("id", "match").orderBy(F.desc("id"), F.desc("match")).limit(25)


@query("o03_or_of_queries", _TOKS + "h AS (SELECT id, ' ' || array_to_string(toks, ' ') || ' ' AS said FROM t) SELECT id FROM h WHERE contains(said, ' mit ') OR contains(said, ' lic')")
def _(s, d):
    toks = T.tokens(F.col("text"))
    return _docs(s, d).where(T.matches(toks, T.parse_query('"mit"')) | T.matches(toks, T.parse_query("lic"))).select("id")


@query("o05_dedup_by_id", "SELECT k, max(event_id) AS event_id FROM (SELECT event_id % 777 AS k, event_id FROM events) GROUP BY 1")
def _(s, d):
    return A.table(s, d, "events").groupBy((F.col("event_id") % 777).alias("k")).agg(F.max("event_id").alias("event_id"))


@query("d01_heartbeat", "SELECT c_custkey AS machine_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'old' || c_custkey END AS hostname FROM customer")
def _(s, d):
    c = A.table(s, d, "customer")
    old = c.select(F.col("c_custkey").alias("machine_id"), F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("hostname"))
    return ingest.upsert(old, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("machine_id"), F.col("c_name").alias("hostname")), ["machine_id"])


@query("d02_guarded_facts", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS fact FROM nation")
def _(s, d):
    n = A.table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("fact"))
    new = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.lit("new")).alias("fact"))
    return ingest.upsert(n, new, ["n_nationkey"], keep_if_absent=["fact"])


@query("d03_rising_flags", "SELECT s_suppkey, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS has_errors FROM supplier")
def _(s, d):
    x = A.table(s, d, "supplier")
    return ingest.upsert(x.select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("has_errors")), x.select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("has_errors")), ["s_suppkey"], either=["has_errors"])


@query("d05_tools_of_new_rows", f"WITH {A.TOOL_USES} SELECT count(*) AS n FROM tool_uses WHERE message_ref IN (SELECT event_id FROM events WHERE event_id % 5 = 0)")
def _(s, d):
    new = A.table(s, d, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("message_ref"))
    return A.tool_uses(s, d).join(new, "message_ref", "left_semi").agg(F.count("*").alias("n"))


@query("d12_backfill", "SELECT event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'k' || json_extract_string(props, '$.k')) AS message_id FROM events")
def _(s, d):
    e = A.table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("message_id"))


@query("d14_append_ignore", "SELECT count(*) AS n FROM events WHERE event_id >= 100")
def _(s, d):
    e = A.table(s, d, "events").select(F.col("event_id").alias("id"))
    return refresh.overlap_rows(e, e.where("id < 100"), 1 << 40).agg(F.count("*").alias("n"))


@query("t01_overlap_rescan", "SELECT event_id AS id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 3 <> 0) - 500 AND event_id % 3 = 0")
def _(s, d):
    e = A.table(s, d, "events").select(F.col("event_id").alias("id"))
    return refresh.overlap_rows(e, e.where("id % 3 <> 0"), 500)


@query("t02_new_markers", "WITH m AS (SELECT event_id AS id, user_id AS session_id, json_extract_string(props, '$.k') AS group_key FROM events), f AS (SELECT session_id, group_key, min(id) AS first FROM m WHERE id >= 400 GROUP BY 1, 2) SELECT m.id, m.id = f.first AND NOT EXISTS (SELECT 1 FROM m o WHERE o.id < 400 AND o.session_id = m.session_id AND o.group_key = m.group_key) AS usage_row FROM m JOIN f USING (session_id, group_key) WHERE m.id >= 400")
def _(s, d):
    m = A.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").alias("group_key"))
    return refresh.mark_new(m.where("id >= 400"), m.where("id < 400")).select("id", "usage_row")


@query("t07_lag", "SELECT max(event_id) - max(event_id) FILTER (WHERE event_id % 1000 < 900) AS behind, CASE WHEN max(event_id) > max(event_id) FILTER (WHERE event_id % 1000 < 900) THEN 'lagging' ELSE 'ok' END AS status FROM events")
def _(s, d):
    e = A.table(s, d, "events").select(F.col("event_id").alias("id"))
    return refresh.lag(e, e.where("id % 1000 < 900"))


@query("t08_changed_files", "SELECT doc_id AS path FROM documents WHERE doc_id % 4 = 0")
def _(s, d):
    f = A.table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("source").alias("modified"))
    return refresh.changed_files(f, f.withColumn("size", F.when(F.col("path") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")))).select("path")


@query("t10_backoff", "WITH a AS (SELECT user_id AS key, ts AS tm, event_type = 'error' AS failed FROM events), r AS (SELECT key, max(tm) AS reset FROM a WHERE NOT failed GROUP BY 1), f AS (SELECT a.key, count(*) AS failures FROM a LEFT JOIN r USING (key) WHERE failed AND (reset IS NULL OR tm > reset) GROUP BY 1) SELECT key, failures, CAST(CASE WHEN failures < 2 THEN 0 ELSE least(1440, 15 * pow(2, least(failures - 2, 16))) END AS INTEGER) AS wait_minutes FROM f")
def _(s, d):
    a = A.messages(s, d).select(F.col("session_id").alias("key"), F.when(F.col("provider") == "error", "failed").otherwise("ok").alias("outcome"), F.col("ts").alias("at"))
    return refresh.retry_after(a, grace=2).drop("retry_at")


@query("g02_keyword_turns", "WITH t AS (SELECT conv_id, turn, role, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS toks FROM conversations), h AS (SELECT *, ' ' || array_to_string(toks, ' ') || ' ' AS said FROM t) SELECT conv_id * 1000 + turn AS id, round(len(list_filter(toks, lambda x: x = 'the')) / (1 + ln(1.0 + len(toks))), 6) AS rank FROM h WHERE contains(said, ' the') ORDER BY rank DESC, id DESC LIMIT 50")
def _(s, d):
    rows = A.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return search.keyword(rows, "the").select("id", "rank")


@query("g08_limited_substring", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'version') ORDER BY n_chars DESC, id LIMIT 100")
def _(s, d):
    rows = A.table(s, d, "documents").where(T.contains_ascii_ci(F.col("text"), "Version"))
    return rows.orderBy(F.desc("n_chars"), "doc_id").limit(100).select(F.col("doc_id").alias("id"))


@query("q04_distinct_like", "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'and')")
def _(s, d):
    return A.table(s, d, "conversations").where(T.contains_ascii_ci(F.col("text"), "AND")).select("conv_id").distinct()


@query("f01_lenient_times", "SELECT doc_id, TRY_CAST('2024-01-' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || ' 10:00:00' AS TIMESTAMP) AS ts FROM documents")
def _(s, d):
    said = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit(" 10:00:00"))
    return _plain_times(A.table(s, d, "documents").select("doc_id", F.try_to_timestamp(said).alias("ts")), "ts")


@query("f04_iso_seconds", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS said FROM events")
def _(s, d):
    return A.table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("said"))


@query("f23_remote_urls", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '^(https?|ssh|git)://([^@/]*@)?', ''), '(\\.git)?/*$', '') AS remote FROM pages")
def _(s, d):
    bare = F.regexp_replace(F.lower("url"), r"^(https?|ssh|git)://([^@/]*@)?", "")
    return A.table(s, d, "pages").select("page_id", F.regexp_replace(bare, r"(\.git)?/*$", "").alias("remote"))


_TOOL_NAMES = ["Read", "WebSearch", "default", "read_file", "str_replace_editor", "mcp__server__call", "codebase_search", "list_files", "ls", "create_file", "File", "TodoUpdate", "runCommand", "git_commit", "http_get", "pdf", "thread", "spread_sheet", "Unknown", "fetchUrl"]


@query("f29_tool_kinds", "SELECT l_orderkey, l_linenumber, kind FROM (SELECT *, list_extract(['code', 'web', 'info', 'code', 'code', 'mcp', 'search', 'neutral', 'file', 'file', 'file', 'task', 'terminal', 'git', 'web', 'document', 'code', 'code', 'neutral', 'web'], CAST((l_orderkey + l_linenumber) % 20 AS INTEGER) + 1) AS kind FROM lineitem)")
def _(s, d):
    names = F.array(*[F.lit(n) for n in _TOOL_NAMES])
    at = ((F.col("l_orderkey") + F.col("l_linenumber")) % 20).cast("int") + 1
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(names, at).alias("name")).select("l_orderkey", "l_linenumber", board.tool_kind("name").alias("kind"))


@query("f31_relevance", "SELECT o_custkey, CASE WHEN n < 3 THEN 0.2::DOUBLE WHEN 5 + CASE WHEN t > 5 THEN 3 ELSE 0 END + CASE WHEN e > 0 THEN 2 ELSE 0 END + CASE WHEN m THEN 2 ELSE 0 END + CASE WHEN c > 0 THEN 3 ELSE 0 END > 10 THEN 1.0::DOUBLE ELSE round((5 + CASE WHEN t > 5 THEN 3 ELSE 0 END + CASE WHEN e > 0 THEN 2 ELSE 0 END + CASE WHEN m THEN 2 ELSE 0 END + CASE WHEN c > 0 THEN 3 ELSE 0 END)::DOUBLE / 10, 6) END AS relevance, CASE WHEN n > 15 OR t > 5 THEN 'deep' ELSE 'shallow' END AS depth FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS t, count(*) FILTER (WHERE o_totalprice > 400000) AS e, bool_or(o_orderpriority = '1-URGENT') AS m, count(*) FILTER (WHERE o_totalprice < 20000) AS c FROM orders GROUP BY 1)")
def _(s, d):
    n = lambda c: F.count(F.when(c, 1))
    x = A.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), n(F.col("o_orderstatus") == "F").alias("t"), n(F.col("o_totalprice") > 400000).alias("e"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("m"), n(F.col("o_totalprice") < 20000).alias("c"))
    return x.select("o_custkey", board.relevance(*(F.col(c) for c in "ntemc")).alias("relevance"), board.depth(F.col("n"), F.col("t")).alias("depth"))


@query("f32_line_counts", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


@query("f36_head_and_tail", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 240) || '...' || right(text, 160) END AS cut FROM documents")
def _(s, d):
    whole = F.col("text")
    return A.table(s, d, "documents").select("doc_id", F.when(F.length(whole) <= 400, whole).otherwise(F.concat(F.substring(whole, 1, 240), F.lit("..."), F.right(whole, F.lit(160)))).alias("cut"))


@query("f40_blob_ids", "SELECT doc_id, regexp_full_match(sha1(text), '[0-9a-f]{40}') AS ok FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).rlike("^[0-9a-f]{40}$").alias("ok"))


@query("f43_presets", "SELECT count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 7) AS week, count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 14) AS fortnight FROM events")
def _(s, d):
    day = F.to_date("ts")
    back = lambda n: F.count(F.when(day >= F.date_sub(F.lit("2024-01-30").cast("date"), n), 1))
    return A.table(s, d, "events").agg(back(7).alias("week"), back(14).alias("fortnight"))


@query("f11_snippets", "SELECT doc_id, CASE WHEN instr(lower(text), 'license') > 0 THEN substr(text, greatest(instr(lower(text), 'license') - 40, 1), 87) END AS snippet FROM documents WHERE contains(lower(text), 'license')")
def _(s, d):
    rows = A.table(s, d, "documents").where(T.contains_ascii_ci(F.col("text"), "license"))
    return rows.select("doc_id", T.snippet(F.col("text"), "license").alias("snippet"))


@query("f14_stub_embedding", "WITH t AS (SELECT item_id, list_transform(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), lambda x: CAST('0x' || substr(sha256(x), 1, 2) AS INTEGER) % 8) AS spots FROM benchmark) SELECT item_id, array_to_string(list_transform(range(8), lambda i: len(list_filter(spots, lambda p: p = i))), ',') AS v FROM t")
def _(s, d):
    from convolake.functions import vectors as V

    v = F.transform(V.stub_embedding(F.col("text"), 8), lambda x: x.cast("long").cast("string"))
    return A.table(s, d, "benchmark").select("item_id", F.array_join(v, ",").alias("v"))


@query("f15_entry_text", "SELECT c_custkey, trim(concat_ws(' ', c_name, nullif(c_mktsegment, ''), CAST(c_nationkey AS VARCHAR))) AS text FROM customer")
def _(s, d):
    return A.table(s, d, "customer").select("c_custkey", F.trim(F.concat_ws(" ", "c_name", F.nullif("c_mktsegment", F.lit("")), F.col("c_nationkey").cast("string"))).alias("text"))


@query("f38_genuine_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS said FROM documents WHERE NOT (starts_with(text, '<') OR starts_with(text, '[') OR trim(text) = '')")
def _(s, d):
    t = F.col("text")
    rows = A.table(s, d, "documents").where(~(t.startswith("<") | t.startswith("[") | (F.trim(t) == "")))
    return rows.select("doc_id", F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t).alias("said"))


@query("f41_size_estimate", "SELECT doc_id, greatest(1, n_chars // 500) AS messages FROM documents")
def _(s, d):
    return A.table(s, d, "documents").select("doc_id", F.greatest(F.lit(1), F.expr("n_chars div 500")).cast("long").alias("messages"))


@query("f42_home_paths", "SELECT page_id, regexp_replace('/home/u' || page_id || '/x', '^/(?:home|Users)/[^/]+', '~') AS path FROM pages")
def _(s, d):
    return A.table(s, d, "pages").select("page_id", T.like_path(F.concat(F.lit("/home/u"), F.col("page_id").cast("string"), F.lit("/x"))).alias("path"))


@query("p17_entrypoints", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE kind = 'vscode') AS of_vscode FROM (SELECT list_extract(['cli', 'cli', 'vscode', 'vscode', 'desktop', 'desktop', NULL, NULL], CAST(event_id % 8 AS INTEGER) + 1) AS kind FROM events) GROUP BY 1")
def _(s, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("cli", "copilot-cli", "claude-vscode", "copilot-vscode", "claude-desktop", "copilot-desktop", "CLI", "sdk-py")]), (F.col("event_id") % 8).cast("int") + 1)
    rows = A.table(s, d, "events").select(T.entrypoint_kind(raw).alias("kind"), T.entrypoint_matches(raw, "vscode").alias("passes"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("passes"), 1)).alias("of_vscode"))


@query("d11_alias_upsert", "SELECT n_name AS project_path, CASE WHEN n_nationkey < 10 THEN 'new' ELSE r_name END AS identity_key FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    p = A.projects(s, d)
    old = p.select(F.col("project_name").alias("project_path"), "identity_key")
    return ingest.upsert(old, p.where("project_id < 10").select(F.col("project_name").alias("project_path"), F.lit("new").alias("identity_key")), ["project_path"])


@query("d17_chunks", """WITH RECURSIVE o AS (SELECT conv_id AS session_id, turn AS id, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT session_id, n, id, 0 AS chunk, 1 AS k, b AS size FROM o WHERE n = 1 UNION ALL SELECT o.session_id, o.n, o.id, CASE WHEN f.k + 1 > 3 OR f.size + o.b > 900 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.k + 1 > 3 OR f.size + o.b > 900 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k + 1 > 3 OR f.size + o.b > 900 THEN o.b ELSE f.size + o.b END FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
SELECT session_id, id, CAST(chunk AS BIGINT) AS chunk FROM f""")
def _(s, d):
    rows = A.turns(s, d).select("session_id", F.col("seq").alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    return ingest.chunk_by_bytes(rows, 3, 900)


@query("d18_replace_nul", "SELECT doc_id, text || chr(65533) AS text, '{\"a' || chr(65533) || '\": [\"' || source || chr(65533) || '\\\\u0000\"]}' AS json FROM documents")
def _(s, d):
    json = F.concat(F.lit('{"a\\u0000": ["'), "source", F.lit('\\u0000\\\\u0000"]}'))
    return A.table(s, d, "documents").select("doc_id", T.replace_nul(F.concat("text", F.lit("\0"))).alias("text"), T.replace_nul(json).alias("json"))


@query("q03_message_scan", "SELECT o_orderkey FROM orders WHERE o_custkey = 10 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _(s, d):
    return browse.browse(A.table(s, d, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 50, o_custkey=10).select("o_orderkey")


@query("q10_missing_columns", "SELECT p_partkey, p_size, CAST(NULL AS VARCHAR) AS tier FROM part")
def _(s, d):
    p = A.table(s, d, "part")
    want = {"p_partkey": "long", "p_size": "int", "tier": "string"}
    return p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in want.items()])
