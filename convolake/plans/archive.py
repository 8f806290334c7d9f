"""Third part of the catalogue: logs read as they grow, stored tables, and what is computed over sessions' trees, edits and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from convolake.functions import blocks, extract, identity
from convolake.functions import text as T
from convolake.operators import edits, filters, grouping, ingest, ranking, search, sequences, transcripts, trees
from convolake.sources import appended, directories, logs, written
from convolake.streaming import markers, refresh
from convolake.streaming.snapshots import Snapshots
from convolake.tables import scratch

from . import adapters as A
from .catalogue import _docs, query


def _folder(s, name: str) -> str:
    return f"{scratch(s)}/{name}-{uuid.uuid4().hex}"


def _said(s, d):
    """Turns as messages with a time, a minute apart."""
    return A.turns(s, d).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60))


_MESSAGES_SQL = "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, conv_id || '-' || turn AS uuid, role, text AS content, 1700000000 + turn * 60 AS at FROM conversations"


def _parsed(rows):
    return rows.select("session_id", "seq", "uuid", "role", "content", F.unix_seconds("ts").alias("at"))


def _write(rows, folder, half=None):
    file = F.concat(F.lit("log"), F.floor(F.col("session_id") / 16).cast("string"))  # 16 sessions a file
    late = F.col("seq") >= 3
    return written.write_files(rows, folder, file, [late, F.col("session_id"), F.col("seq")], written.canonical_line(), late if half else None)


@query("s01_canonical_logs", _MESSAGES_SQL)
def _(s, d):
    folder = _folder(s, "logs")
    _write(_said(s, d), folder)
    return _parsed(logs.canonical(s, f"{folder}/*.jsonl"))


@query("s35_appended_logs", _MESSAGES_SQL)
def _(s, d):
    """Logs that are read twice: first while each file's first late line is half written, then when they are whole."""
    folder = _folder(s, "logs")
    for half in (True, False):
        _write(_said(s, d), f"{folder}/logs", half)
        appended.follow(s, f"{folder}/logs", f"{folder}/lines", f"{folder}/checkpoint").awaitTermination()
    held = appended.lines(s, f"{folder}/lines")
    return _parsed(logs.canonical_lines(held.select("file", F.lit(0).alias("block"), F.col("at").alias("line"), "value")))


@query("d15_rebuild", f"WITH {A.MESSAGES} SELECT session_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before, count(*) AS after, count(*) FILTER (WHERE usage_row) AS usage_rows FROM messages GROUP BY 1")
def _(s, d):
    """A reader that opened the table before it was rebuilt (once in vain), and one that opened it afterwards."""
    store, rows = Snapshots(s, _folder(s, "rebuilt")), A.messages(s, d)
    store.rebuild(lambda: rows.where("ts < '2024-01-16'"))
    old = store.read()
    try:
        store.rebuild(lambda: rows.withColumn("id", F.raise_error(F.lit("lost"))))
    except Exception as e:
        if "lost" not in str(e):
            raise
    store.rebuild(lambda: rows)
    both = old.select("session_id", F.lit(1).alias("old"), F.lit(0).alias("new"), F.lit(0).alias("used")).unionByName(store.read().select("session_id", F.lit(0).alias("old"), F.lit(1).alias("new"), F.col("usage_row").cast("int").alias("used")))
    return both.groupBy("session_id").agg(F.sum("old").alias("before"), F.sum("new").alias("after"), F.sum("used").alias("usage_rows"))


@query("t09_marked_stream", f"WITH {A.MESSAGES} SELECT session_id, group_key, count(*) AS rows, min(id) FILTER (WHERE usage_row) AS first_id FROM messages GROUP BY 1, 2")
def _(s, d):
    """Messages that come in four deliveries, each with a part of the one before again, into a stored table with markers."""
    folder = _folder(s, "marked")
    rows = A.messages(s, d).drop("usage_row")
    top = rows.agg(F.max("id")).first()[0] or 0
    step = top // 4 + 1
    for n in range(4):
        rows.where((F.col("id") >= n * step - step // 3) & (F.col("id") < (n + 1) * step)).write.parquet(f"{folder}/in/part={n}")
        stream = s.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*")
        markers.mirror(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return Snapshots(s, f"{folder}/table").read().groupBy("session_id", "group_key").agg(F.count("*").alias("rows"), F.min(F.when(F.col("usage_row"), F.col("id"))).alias("first_id"))


_TREE_SQL = """WITH RECURSIVE raw AS (
  SELECT o_orderkey // 64 AS session_id, o_orderkey AS node, CASE WHEN o_orderkey % 64 = 0 THEN NULL WHEN o_orderkey % 31 = 9 THEN o_orderkey - 1000000 WHEN o_orderkey % 17 = 5 THEN o_orderkey + 1 ELSE o_orderkey - o_orderkey % 3 - 1 END AS parent, o_orderdate AS ts, o_orderkey AS seq, o_orderkey % 23 = 3 AS hidden FROM orders
  UNION ALL SELECT o_orderkey // 64, o_orderkey, NULL, o_orderdate + INTERVAL 1 DAY, 1000000000 + o_orderkey, FALSE FROM orders WHERE o_orderkey % 29 = 0),
nodes AS (SELECT * EXCLUDE (r, seq), first AS seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id, node ORDER BY seq DESC) AS r, min(seq) OVER (PARTITION BY session_id, node) AS first FROM raw) WHERE r = 1),
t AS (SELECT session_id, node, hidden, FALSE AS below, [{'t': ts, 's': seq}] AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT c.session_id, c.node, c.hidden, p.below OR p.hidden, list_append(p.path, {'t': c.ts, 's': c.seq}) FROM t p JOIN nodes c ON c.session_id = p.session_id AND c.parent = p.node),
sums AS (SELECT n.session_id, count(*) AS whole, count(t.node) FILTER (WHERE NOT t.below) AS kept, bool_or(n.parent IS NULL) AS rooted FROM nodes n LEFT JOIN t USING (session_id, node) GROUP BY 1),
parts AS (SELECT n.*, t.path, CASE WHEN NOT rooted THEN 0 WHEN t.node IS NOT NULL THEN CASE WHEN NOT t.below THEN 1 END WHEN kept < whole * 0.9 THEN 2 END AS part FROM nodes n JOIN sums USING (session_id) LEFT JOIN t USING (session_id, node))
SELECT session_id, node, row_number() OVER (PARTITION BY session_id ORDER BY part, CASE WHEN part = 1 THEN path END, CASE WHEN part = 2 THEN ts END, seq) - 1 AS place FROM parts WHERE part IS NOT NULL"""


@query("w12_reading_order", _TREE_SQL)
def _(s, d):
    """Trees of 64 messages with missing parents, cycles, hidden messages, and some that come again with other values."""
    k = F.col("o_orderkey")
    o = A.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    parent = F.when(k % 64 == 0, None).when(k % 31 == 9, k - 1_000_000).when(k % 17 == 5, k + 1).otherwise(k - k % 3 - 1)
    session = F.floor(k / 64).alias("session_id")
    rows = o.select(session, k.alias("node"), parent.alias("parent"), "ts", k.alias("seq"), (k % 23 == 3).alias("hidden"))
    again = o.where(k % 29 == 0).select(session, k.alias("node"), F.lit(None).cast("long").alias("parent"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), (k + 1_000_000_000).alias("seq"), F.lit(False).alias("hidden"))
    return trees.reading_order(rows.unionByName(again))


_REPLACED = "CASE WHEN instr({0}, {1}) > 0 THEN substr({0}, 1, instr({0}, {1}) - 1) || {2} || substr({0}, instr({0}, {1}) + length({1})) ELSE {0} END"
_LINES = "(length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN {0} <> '' AND right({0}, 1) <> chr(10) THEN 1 ELSE 0 END)"


@query("f32_edits", f"""WITH x AS (SELECT doc_id, doc_id % 4 AS k, coalesce(text, '') AS text, split_part(coalesce(text, ''), ' ', 2) AS word FROM documents),
m AS (SELECT *, {_REPLACED.format("text", "word", "'<' || chr(10) || word || '>'")} AS once FROM x), n AS (SELECT *, {_REPLACED.format("once", "'>'", "''")} AS twice FROM m)
SELECT doc_id, CASE WHEN k = 0 THEN 'write' ELSE 'edit' END AS op, CASE WHEN k = 3 THEN '/work/' ELSE '/w/' END || 'f' || doc_id % 50 AS file_path, md5(CASE k WHEN 0 THEN text WHEN 1 THEN once WHEN 2 THEN twice ELSE '*** Update File: f' || doc_id % 50 || chr(10) || '-' || replace(text, chr(10), chr(10) || '+') END) AS content,
CAST(CASE k WHEN 0 THEN {_LINES.format("text")} WHEN 1 THEN 1 + {_LINES.format("(word || '>')")} WHEN 2 THEN 1 + {_LINES.format("(word || '>')")} ELSE len(list_filter(string_split('-' || replace(text, chr(10), chr(10) || '+'), chr(10)), lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++'))) END AS INTEGER) AS lines_added,
CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN {_LINES.format("word")} WHEN 2 THEN {_LINES.format("word")} + 1 ELSE CASE WHEN starts_with(text, '--') THEN 0 ELSE 1 END END AS INTEGER) AS lines_removed FROM n""")
def _(s, d):
    """Documents as messages that create a file, replace their second word once or in two steps, or patch a file."""
    x = A.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    word, name = F.split_part("text", F.lit(" "), F.lit(2)), F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"))
    new = F.concat(F.lit("<\n"), word, F.lit(">"))
    path = F.concat(F.lit("/w/"), name)
    kind = F.col("doc_id") % 4
    result = F.when(kind == 0, F.to_json(F.struct(F.struct(F.lit("create").alias("type"), path.alias("filePath"), F.col("text").alias("content")).alias("toolUseResult"))))
    result = result.when(kind == 1, F.to_json(F.struct(F.struct(path.alias("filePath"), word.alias("oldString"), new.alias("newString"), F.col("text").alias("originalFile")).alias("toolUseResult"))))
    steps = F.array(F.struct(word.alias("old_string"), new.alias("new_string")), F.struct(F.lit(">").alias("old_string"), F.lit("").alias("new_string")))
    result = result.when(kind == 2, F.to_json(F.struct(F.struct(path.alias("filePath"), steps.alias("edits"), F.col("text").alias("originalFile")).alias("toolUseResult"))))
    patch = F.concat(F.lit("*** Update File: "), name, F.lit("\n-"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    use = F.struct(F.lit("tool_use").alias("type"), F.lit("apply_patch").alias("name"), F.struct(patch.alias("patch")).alias("input"))
    rows = x.select("doc_id", result.alias("raw")).where("raw is not null")
    patches = x.where(kind == 3).select("doc_id", F.to_json(F.struct(F.array(use).alias("content"))).alias("raw"), F.lit("/work").alias("cwd"))
    both = edits.edits(rows).unionByName(edits.edits(patches, cwd="cwd").drop("cwd"))
    return both.select("doc_id", "op", "file_path", F.md5("content").alias("content"), "lines_added", "lines_removed")


_POSTINGS = "WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS toks FROM documents), p AS (SELECT id, unnest(toks) AS token, unnest(range(len(toks))) AS pos, len(toks) AS length FROM t)"


@query("f10_positional_rank", _POSTINGS + """, h AS (SELECT * FROM p WHERE token IN ('license', 'version', 'copyright')), full_ AS (SELECT id FROM h GROUP BY id HAVING count(DISTINCT token) = 3),
s AS (SELECT a.id, sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2))))) AS s FROM h a JOIN h b ON a.id = b.id AND a.token < b.token AND abs(a.pos - b.pos) <= 100 GROUP BY 1)
SELECT id, round(1 - exp(coalesce(s, 0)), 6) AS rank FROM full_ LEFT JOIN s USING (id)""")
def _(s, d):
    return ranking.rank(ranking.positions(_docs(s, d)), ["license", "version", "copyright"])


@query("f10_single_word_rank", _POSTINGS + ", h AS (SELECT id, count(*) AS n FROM p WHERE token = 'license' GROUP BY 1) SELECT id, round(0.1 * list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j))) / (pi() * pi() / 6), 6) AS rank FROM h ORDER BY rank DESC, id DESC LIMIT 50")
def _(s, d):
    return ranking.best(ranking.rank(ranking.positions(_docs(s, d)), ["license"]))


@query("g01_stored_index", _POSTINGS + ", h AS (SELECT id, length, count(*) AS tf, count(DISTINCT token) AS w FROM p WHERE token IN ('license', 'version') GROUP BY 1, 2) SELECT id, round(tf / (1 + ln(1.0 + length)), 6) AS rank FROM h WHERE w = 2 ORDER BY rank DESC, id DESC LIMIT 50")
def _(s, d):
    """The index is written in two increments; the search reads the folders of its two words."""
    index, docs = ranking.StoredIndex(s, _folder(s, "index")), _docs(s, d)
    for n in range(2):
        index.add(docs.where(F.col("id") % 2 == n), n + 1)
    words = ["license", "version"]
    return search.by_postings(index.words(words).select("token", "id", F.size("positions").alias("tf"), "length"), words)


_FRAGMENTS_SQL = """WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+[^\\p{L}\\p{N}_]*') AS pieces, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS toks FROM documents),
h AS (SELECT * FROM (SELECT id, unnest(toks) AS word, unnest(range(len(toks))) AS pos, len(toks) AS n FROM t) WHERE word IN ('license', 'version')),
w AS (SELECT id, n, pos AS b, max(pos) OVER r AS e, len(list_distinct(list(word) OVER r)) AS diff, count(*) OVER r AS hits FROM h WINDOW r AS (PARTITION BY id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 13 FOLLOWING)),
one AS (SELECT id, n, b, e FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY diff DESC, hits DESC, e - b, b) AS r FROM w) WHERE r = 1),
p1 AS (SELECT id, n, greatest(hi - 13, 0) AS lo, hi FROM (SELECT id, n, least(greatest(b - (14 - (e - b + 1)) // 2, 0) + 13, n - 1) AS hi FROM one)),
two AS (SELECT id, n, b, e, lo AS lo1, hi AS hi1 FROM (SELECT w.*, lo, hi, row_number() OVER (PARTITION BY w.id ORDER BY diff DESC, hits DESC, e - b, b) AS r FROM w JOIN p1 USING (id) WHERE b > hi OR e < lo) WHERE r = 1),
lim AS (SELECT *, CASE WHEN hi1 < b THEN hi1 + 1 ELSE 0 END AS low, CASE WHEN lo1 > e THEN lo1 - 1 ELSE n - 1 END AS high FROM two),
p2 AS (SELECT id, greatest(hi - 13, low) AS lo, hi FROM (SELECT id, low, least(greatest(b - (14 - (e - b + 1)) // 2, low) + 13, high) AS hi FROM lim)),
parts AS (SELECT id, lo, hi FROM p1 UNION ALL SELECT id, lo, hi FROM p2 WHERE hi - lo + 1 >= 3),
said AS (SELECT id, lo, array_to_string(list_transform(range(lo, hi + 1), lambda i: CASE WHEN toks[i + 1] IN ('license', 'version') THEN '<b>' || regexp_extract(pieces[i + 1], '^[\\p{L}\\p{N}_]+') || '</b>' ELSE regexp_extract(pieces[i + 1], '^[\\p{L}\\p{N}_]+') END || CASE WHEN i < hi THEN regexp_replace(pieces[i + 1], '^[\\p{L}\\p{N}_]+', '') ELSE '' END), '') AS s FROM parts JOIN t USING (id))
SELECT id, string_agg(s, ' ... ' ORDER BY lo) AS snippet FROM said GROUP BY 1"""


@query("f11_fragments", _FRAGMENTS_SQL)
def _(s, d):
    words = ["license", "version"]
    found = _docs(s, d).where(F.arrays_overlap(T.tokens(F.col("text")), F.array(*[F.lit(w) for w in words])))
    return ranking.fragments(found, words)


def _projects(s, d):
    """Part types as machines and providers, part names under a few directories as paths, brands as identities."""
    k = F.col("p_partkey")
    root = F.when(k % 5 == 0, "/home/a/dev").when(k % 5 == 1, "/home/b/dev").when(k % 5 == 2, "/srv/a/dev").when(k % 5 == 3, "/srv/x/a/dev").otherwise("/opt")
    path = F.concat(root, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/r"), (k % 40).cast("string"))
    return A.table(s, d, "part").select(F.col("p_type").alias("machine"), F.concat(F.lit("p"), (F.col("p_size") % 4).cast("string")).alias("provider"), path.alias("project_path"), F.when(k % 7 == 0, F.concat("p_brand", (k % 3).cast("string"))).alias("identity_key"), (F.col("p_size") > 30).alias("git_worktree"), F.when(k % 11 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + k * 977 % 86_400)).alias("last_modified"))


_SUFFIX = "label{0} AS (SELECT g.* EXCLUDE (suffix, label, same), CASE WHEN same > 1 THEN coalesce(nullif(array_to_string(parents[greatest(len(parents) - {0} + 1, 1):], '/'), ''), suffix) ELSE suffix END AS suffix, CASE WHEN (CASE WHEN same > 1 THEN coalesce(nullif(array_to_string(parents[greatest(len(parents) - {0} + 1, 1):], '/'), ''), suffix) ELSE suffix END) IS NULL THEN name ELSE name || ' — ' || (CASE WHEN same > 1 THEN coalesce(nullif(array_to_string(parents[greatest(len(parents) - {0} + 1, 1):], '/'), ''), suffix) ELSE suffix END) END AS label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS same FROM {1}) g)"


@query("a33_groups", f"""WITH p AS (SELECT p_type AS machine, 'p' || p_size % 4 AS provider, CASE p_partkey % 5 WHEN 0 THEN '/home/a/dev' WHEN 1 THEN '/home/b/dev' WHEN 2 THEN '/srv/a/dev' WHEN 3 THEN '/srv/x/a/dev' ELSE '/opt' END || '/' || replace(p_name, ' ', '/') || '/r' || p_partkey % 40 AS path,
  CASE WHEN p_partkey % 7 = 0 THEN p_brand || p_partkey % 3 END AS own, p_size > 30 AS wt, CASE WHEN p_partkey % 11 <> 0 THEN 1700000000 + p_partkey * 977 % 86400 END AS modified FROM part),
al AS (SELECT path, 'alias' || min(provider) AS a FROM p WHERE ends_with(path, 'r39') GROUP BY 1), r AS (SELECT p.*, coalesce(own, a) AS o FROM p LEFT JOIN al USING (path)),
c AS (SELECT path, min(o) AS lo, max(o) AS hi FROM r WHERE o IS NOT NULL GROUP BY 1), k AS (SELECT r.*, coalesce(o, CASE WHEN lo = hi THEN lo END, 'path:' || path) AS key FROM r LEFT JOIN c USING (path)),
f AS (SELECT key, path, bool_and(wt) AS wt, max(modified) AS modified, count(*) AS n FROM k GROUP BY 1, 2), live AS (SELECT * FROM f WHERE NOT wt),
g AS (SELECT key, first(path ORDER BY modified DESC NULLS LAST, path) AS path, count(*) AS paths, CAST(sum(n) AS BIGINT) AS rows, max(modified) AS modified FROM live GROUP BY 1),
label0 AS (SELECT *, parts[len(parts)] AS name, parts[:len(parts) - 1] AS parents, CAST(NULL AS VARCHAR) AS suffix, parts[len(parts)] AS label FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM g)),
{", ".join(_SUFFIX.format(n, f"label{n - 1}") for n in range(1, 7))} SELECT key, path, label, paths, rows, modified FROM label6""")
def _(s, d):
    p = _projects(s, d)
    aliases = p.where("endswith(project_path, 'r39')").groupBy("project_path").agg(F.concat(F.lit("alias"), F.min("provider")).alias("identity_key"))
    out = grouping.groups(p, aliases, worktrees=False)
    return out.select("key", "path", "label", "paths", "rows", F.unix_seconds("last_modified").alias("modified"))


def _context_folder(s, d) -> str:
    """Each conversation as a folder with context.jsonl, wire.jsonl and, for some, state.json."""
    folder, rows = _folder(s, "folders"), _said(s, d)
    name = lambda file: F.concat(F.lit("p/s-"), F.col("session_id").cast("string"), F.lit(f"/{file}"))
    call = F.array(F.struct(F.lit("c").alias("id"), F.struct(F.lit("Shell").alias("name"), F.lit('{"n":1}').alias("arguments")).alias("function")))
    role = F.when(F.col("role") == "system", "_system_prompt").otherwise(F.col("role"))
    record = F.to_json(F.struct(role.alias("role"), F.col("text").alias("content"), F.when((F.col("role") == "assistant") & (F.col("session_id") % 2 == 0), call).alias("tool_calls")))
    written.write_files(rows, folder, name("context"), [F.col("seq")], record)
    written.write_files(rows, folder, name("wire"), [F.col("seq")], F.to_json(F.struct((F.unix_seconds("ts") + 0.5).alias("timestamp"))))
    titled = rows.where("session_id % 3 = 0").groupBy("session_id").agg(F.concat(F.lit(" Title "), F.count("*").cast("string")).alias("custom_title"))
    written.write_files(titled, folder, name("state"), [F.col("session_id")], F.to_json(F.struct("custom_title")), suffix=".json")
    return folder


@query("s10_context_sessions", """WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM conversations), u AS (SELECT conv_id, first(text ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1)
SELECT 's-' || s AS session_id, count(*) FILTER (WHERE role IN ('user', 'assistant', 'tool')) AS message_count, conv_id % 2 = 0 AND bool_or(role = 'assistant') AS has_tool_use, 1700000000500000 + 60000000 * min(turn) AS first_at, 1700000000500000 + 60000000 * max(turn) AS last_at, coalesce(CASE WHEN conv_id % 3 = 0 THEN 'Title ' || count(*) END, any_value(u.text)) AS summary
FROM c LEFT JOIN u USING (conv_id) GROUP BY conv_id, s HAVING count(*) FILTER (WHERE role IN ('user', 'assistant', 'tool')) > 0""")
def _(s, d):
    out = directories.context_sessions(s, _context_folder(s, d))
    at = lambda c: F.unix_micros(c).alias(c.split("_")[0] + "_at")
    return out.select("session_id", "message_count", "has_tool_use", at("first_message_time"), at("last_message_time"), "summary")


@query("s10_context_messages", """SELECT 's-' || conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role, text, 1700000000500000 + 60000000 * min(first) OVER (PARTITION BY conv_id) AS at, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 'Shell' END AS tool
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) WHERE role IN ('user', 'assistant', 'tool')""")
def _(s, d):
    out = directories.context_messages(s, _context_folder(s, d))
    said = F.get_json_object("content", "$[0].text")
    return out.select("session_id", "seq", "role", said.alias("text"), F.unix_micros("ts").alias("at"), F.get_json_object("content", "$[1].name").alias("tool"))


@query("s13_storage_messages", """SELECT CAST(conv_id AS VARCHAR) AS session_id, 'm' || conv_id || '-' || turn AS uuid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, 'm' || conv_id || '-' || turn) - 1 AS INTEGER) AS seq, role, text, CASE WHEN turn % 2 = 0 THEN length(text) ELSE 2 * length(text) + 1 END AS input_tokens, CASE WHEN turn % 2 = 0 THEN NULL ELSE 3 END AS output_tokens FROM conversations""")
def _(s, d):
    """Messages of their own files, their parts in others: two steps and a text; every second message counts its tokens itself."""
    folder, rows = _folder(s, "storage"), _said(s, d)
    key = F.concat(F.lit("m"), F.col("session_id").cast("string"), F.lit("-"), F.col("seq").cast("string"))
    own = F.when(F.col("seq") % 2 == 0, F.struct(F.length("text").alias("input")))
    message = F.to_json(F.struct("role", F.struct((F.unix_seconds("ts") * 1000).alias("created")).alias("time"), own.alias("tokens")))
    written.write_files(rows, f"{folder}/storage/message", F.concat_ws("/", F.col("session_id").cast("string"), key), [F.col("seq")], message, suffix=".json")
    step = lambda n, out: F.to_json(F.struct(F.lit("step-finish").alias("type"), F.struct(n.alias("input"), out.alias("output")).alias("tokens")))
    parts = F.array(F.to_json(F.struct(F.lit("text").alias("type"), "text")), step(F.length("text"), F.lit(3)), step(F.length("text") + 1, F.lit(None).cast("int")))
    each = rows.select(key.alias("key"), F.posexplode(parts).alias("n", "part"))
    written.write_files(each, f"{folder}/storage/part", F.concat_ws("/", "key", F.col("n").cast("string")), [F.col("n")], F.col("part"), suffix=".json")
    out = directories.storage_messages(s, folder)
    return out.select("session_id", "uuid", "seq", "role", F.get_json_object("content", "$[0].text").alias("text"), "input_tokens", "output_tokens")


@query("j22_transcripts", """SELECT CAST(conv_id AS VARCHAR) AS agent_id, count(*) AS message_count, min(1700000000 + turn * 60) AS first_at, max(1700000000 + turn * 60) AS last_at, substr(first(text ORDER BY turn) FILTER (WHERE role = 'user' AND text IS NOT NULL), 1, 100) AS summary, CASE WHEN conv_id % 2 = 0 THEN 'toolu_' || conv_id END AS tool_use_id FROM conversations GROUP BY conv_id""")
def _(s, d):
    folder, rows = _folder(s, "agents"), _said(s, d)
    name = F.concat(F.lit("agent-"), F.col("session_id").cast("string"))
    written.write_files(rows, folder, name, [F.col("seq")], written.canonical_line())
    known = rows.where("session_id % 2 = 0").select("session_id").distinct()
    written.write_files(known, folder, name, [F.col("session_id")], F.to_json(F.struct(F.concat(F.lit("toolu_"), F.col("session_id").cast("string")).alias("toolUseId"))), suffix=".meta.json")
    at = lambda c: F.unix_seconds(F.to_timestamp(c)).alias(c.split("_")[0] + "_at")
    return directories.transcripts(s, folder).select("agent_id", "message_count", at("first_message_time"), at("last_message_time"), "summary", "tool_use_id")


@query("f34_blocks", """WITH x AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 AS k, CASE doc_id % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Read' ELSE 'Bash' END AS tool FROM documents)
SELECT doc_id, md5(CASE k WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 10000) || ' ' || substr(text, 1, 10000) || ' ' || tool WHEN 2 THEN text || ' ' || substr(text, 1, 5000) WHEN 3 THEN text || ' u' || doc_id ELSE '' END) AS searchable,
CASE k WHEN 1 THEN 'use' || doc_id WHEN 2 THEN 'use' || doc_id ELSE '' END AS ids, k IN (1, 2) AS tool_calls, contains(lower(text), 'error') AS errors, k = 1 AND tool = 'Edit' AS file_changes FROM x""")
def _(s, d):
    """Documents as messages: plain text, text with thoughts and a tool use, a tool's result, a found page, an image."""
    x = A.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, key = F.col("doc_id") % 5, F.concat(F.lit("use"), F.col("doc_id").cast("string"))
    tool = F.when(F.col("doc_id") % 3 == 0, "Edit").when(F.col("doc_id") % 3 == 1, "Read").otherwise("Bash")
    lit = lambda **c: [F.lit(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in c.items()]
    block = lambda **c: F.to_json(F.struct(*lit(**c)))
    text = F.col("text")
    many = F.concat(F.lit('{"type":"assistant","content":['), F.concat_ws(",", block(type="text", text=text), block(type="thinking", thinking=text), block(type="tool_use", id=key, name=tool)), F.lit("]}"))
    result = F.concat(F.lit('{"type":"user","content":['), block(type="tool_result", tool_use_id=key, content=text), F.lit('],"toolUseResult":'), block(stdout=text), F.lit("}"))
    page = F.concat(F.lit('{"content":[{"type":"web_search_tool_result","content":['), block(title=text, url=F.concat(F.lit("u"), F.col("doc_id").cast("string"))), F.lit("]}]}"))
    image = F.concat(F.lit('{"content":['), block(type="image", text=text), F.lit("]}"))
    raw = F.when(k == 0, F.to_json(F.struct(F.lit("user").alias("type"), text.alias("content")))).when(k == 1, many).when(k == 2, result).when(k == 3, page).otherwise(image)
    v = F.col("v")
    rows = x.select("doc_id", F.parse_json(raw).alias("v"))
    return rows.select("doc_id", F.md5(blocks.searchable_text(v)).alias("searchable"), blocks.tool_ids(v).alias("ids"), blocks.has_tool_calls(v).alias("tool_calls"), blocks.has_errors(v).alias("errors"), blocks.has_file_changes(v).alias("file_changes"))


# --- filters, names and ingest by the library's functions

_KINDS = ["user", "assistant", "system", "progress", "summary", "pr-link"]


def _rows_of_log(s, d):
    """Events as log rows: type by number, subtype of system rows, meta and side-chain marks, provider, usage."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 6).cast("int") + 1)
    subtype = F.when(k % 4 == 0, "turn_duration").when(k % 4 == 1, "api_error").when(k % 4 == 2, "stop_hook_summary")
    return A.table(s, d, "events").select(k.alias("id"), kind.alias("type"), subtype.alias("subtype"), (k % 5 == 0).alias("is_meta"), F.when(k % 7 < 3, k % 7 == 0).alias("is_sidechain"), F.when(k % 3 == 0, "antigravity").otherwise("other").alias("provider"), F.when(k % 11 < 5, k % 11 < 2).alias("has_usage"))


_LOG = "WITH r AS (SELECT event_id AS id, ['user', 'assistant', 'system', 'progress', 'summary', 'pr-link'][event_id % 6 + 1] AS type, CASE event_id % 4 WHEN 0 THEN 'turn_duration' WHEN 1 THEN 'api_error' WHEN 2 THEN 'stop_hook_summary' END AS subtype, event_id % 5 = 0 AS meta, event_id % 7 = 0 AS side, event_id % 3 = 0 AS made, event_id % 11 < 2 AS usage FROM events) "


@query("p12_viewer_rows", _LOG + "SELECT id, type IN ('user', 'assistant', 'summary') OR type = 'system' AND subtype IS NOT DISTINCT FROM 'api_error' AS shown, type IN ('user', 'assistant', 'system') AND NOT meta AND NOT side AS counted FROM r")
def _(s, d):
    r = _rows_of_log(s, d)
    return r.select("id", filters.visible(F.col("type"), F.col("subtype")).alias("shown"), filters.counted(F.col("type"), F.col("is_meta"), F.col("is_sidechain")).alias("counted"))


@query("p10_made_up_prompts", _LOG + "SELECT type, count(*) AS n FROM r WHERE NOT (made AND type = 'user' AND NOT usage) GROUP BY 1")
def _(s, d):
    r = _rows_of_log(s, d).where(~filters.synthetic_prompt(F.col("provider"), F.col("type"), F.col("has_usage")))
    return r.groupBy("type").agg(F.count("*").alias("n"))


@query("p15_roles_and_contents", _LOG + "SELECT id FROM r WHERE type <> 'assistant' AND CASE WHEN made THEN true ELSE meta OR usage END")
def _(s, d):
    r = _rows_of_log(s, d)
    keep = filters.chosen(F.col("type"), F.col("is_meta"), F.col("is_sidechain"), F.col("has_usage"), F.col("provider") == "antigravity", {"assistant": False}, {"thinking": False})
    return r.where(keep).select("id")


@query("p16_cards", """WITH c AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_returnflag, '') AS model, list_distinct(list('f' || l_linenumber || CASE WHEN l_linenumber = 2 THEN '.MD' ELSE '.py' END)) AS files, bool_or(l_quantity > 45) AS err, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, contains(model, 'A') AS by_model, CASE WHEN n % 3 = 0 THEN true ELSE list_contains(files, 'f2.MD') END AS by_document, n % 3 = 1 OR err AS by_code, err AS by_status, list_contains(files, 'f1.py') AS by_file FROM c""")
def _(s, d):
    """Orders as cards: flags as models, lines as edited files, the number of lines as the kind of tool."""
    x = A.table(s, d, "lineitem").select("l_orderkey", "l_returnflag", F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 2, ".MD").otherwise(".py")).alias("file"), (F.col("l_quantity") > 45).alias("err"))
    c = x.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("model"), F.collect_set("file").alias("edited_files"), F.bool_or("err").alias("is_error"), F.count("*").alias("n"))
    c = c.withColumn("variant", F.when(F.col("n") % 3 == 0, "document").when(F.col("n") % 3 == 1, "code").otherwise("search"))
    card = {n: F.col(n) for n in ("model", "variant", "edited_files", "is_error")} | {"is_file_edit": F.col("is_error"), "is_cancelled": F.lit(False), "is_commit": F.lit(False), "is_git": F.lit(False)}
    by = {"by_model": ("model", "A"), "by_document": ("tool", "document"), "by_code": ("tool", "code"), "by_status": ("status", "error"), "by_file": ("file", "1.py")}
    return c.select("k", *[filters.brush(*b, card).alias(n) for n, b in by.items()])


@query("p23_sub_agents", "SELECT page_id % 3 = 0 AS sub, count(*) AS n FROM pages GROUP BY 1")
def _(s, d):
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/p\\subagents/"), "url")).otherwise(F.concat(F.lit("/p/subagents_"), "url"))
    return A.table(s, d, "pages").groupBy(filters.is_sub_agent(path).alias("sub")).agg(F.count("*").alias("n"))


@query("f23_remotes", """WITH u AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^https?://([^/]*)/([^?#]*)', 1) AS host, nullif(trim(regexp_extract(url, '^https?://([^/]*)/([^?#]*)', 2), '/'), '') AS path FROM pages)
SELECT page_id, CASE WHEN k = 4 OR k = 5 THEN NULL ELSE lower(host) || CASE WHEN k = 2 THEN ':8443' ELSE '' END || '/' || path END AS remote FROM u""")
def _(s, d):
    """Pages' addresses as remotes: with a scheme and user, as host:path, with a port, as host/path, as files, and without a dot."""
    host, path = F.regexp_extract("url", "^https?://([^/]*)/([^?#]*)", 1), F.regexp_extract("url", "^https?://([^/]*)/([^?#]*)", 2)
    k = F.col("page_id") % 6
    forms = [F.concat(F.lit("HTTPS://me:pw@"), F.upper(host), F.lit("/"), path, F.lit(".git/")), F.concat(F.lit(" git@"), host, F.lit(":/"), path, F.lit(".git")), F.concat(host, F.lit(":8443/"), path), F.concat(host, F.lit("//"), path, F.lit("/")), F.concat(F.lit("file://"), host, F.lit("/"), path)]
    raw = F.lit("localhost:x/y")
    for n, form in enumerate(forms):
        raw = F.when(k == n, form).otherwise(raw)
    return A.table(s, d, "pages").select("page_id", identity.remote_url(raw).alias("remote"))


@query("f40_blob_checks", "SELECT doc_id % 4 AS k, count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 0) AS valid FROM documents GROUP BY 1")
def _(s, d):
    """Hashes as they are, in capitals, cut, and with one more sign."""
    h, k = F.sha1(F.col("text").cast("binary")), F.col("doc_id") % 4
    form = F.when(k == 0, h).when(k == 1, F.concat(F.lit("A"), F.substring(F.upper(h), 2, 39))).when(k == 2, F.substring(h, 1, 39)).otherwise(F.concat(h, F.lit("0")))
    return A.table(s, d, "documents").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count(F.when(identity.is_blob_id(form), 1)).alias("valid"))


@query("f17_message_keys", "SELECT conv_id AS session_id, turn AS seq, sha256(encode('p' || chr(0) || conv_id || chr(0) || '2025' || chr(0) || role || chr(0) || chr(CAST(turn AS INTEGER))) || encode(chr(0) || chr(0) || chr(0)) || encode(CAST(to_json(text) AS VARCHAR)) || encode(chr(1))) AS key FROM conversations")
def _(s, d):
    t = A.turns(s, d)
    content = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    none = F.lit(None).cast("string")
    key = identity.message_key(F.lit("p"), F.col("session_id").cast("string"), F.lit("2025"), F.col("role"), F.col("seq"), content, none, none)
    return t.select("session_id", "seq", key.alias("key"))


@query("d01_heartbeat_floor", """SELECT c_custkey AS machine_id, CASE WHEN c_custkey % 4 = 1 THEN 'new' ELSE c_name END AS hostname, c_custkey % 4 = 1 OR c_custkey % 4 = 2 OR c_custkey % 10 = 0 AS written FROM customer WHERE c_custkey % 4 <> 3 OR c_custkey % 10 <> 0 OR c_custkey % 4 = 3""")
def _(s, d):
    """Machines that say the same within a minute (0), another name (1), the same after a minute (2), nothing (3); every tenth is new."""
    c = A.table(s, d, "customer").select(F.col("c_custkey").alias("machine_id"), F.col("c_name").alias("hostname"))
    k, at = F.col("machine_id") % 4, F.lit("2025-01-01 00:00:00").cast("timestamp")
    old = c.where("machine_id % 10 <> 0").select("machine_id", "hostname", F.lit("x").alias("os"), at.alias("first_seen"), F.when(k == 2, at).otherwise(at + F.expr("interval 30 seconds")).alias("last_seen"))
    batch = c.where("machine_id % 4 <> 3 or machine_id % 10 = 0").select("machine_id", F.when(k == 1, "new").otherwise(F.col("hostname")).alias("hostname"), F.lit("x").alias("os"))
    return ingest.heartbeat(old, batch, "2025-01-01 00:01:10").select("machine_id", "hostname", "written")


@query("d02_effective_identity", """SELECT p_partkey AS machine_id, CASE WHEN p_partkey % 2 = 0 THEN sha1(p_name) END AS git_root_commit, CASE WHEN p_partkey % 3 <> 2 THEN 'h.io/' || p_partkey END AS git_remote_url,
CASE WHEN p_partkey % 2 = 0 THEN 'g:' || sha1(p_name) || CASE WHEN p_partkey % 3 <> 2 THEN '|h.io/' || p_partkey ELSE '' END WHEN p_partkey % 3 <> 2 THEN 'r:h.io/' || p_partkey END AS identity_key FROM part""")
def _(s, d):
    """Stored projects know their root, a batch knows remotes of some and says nothing valid of the others."""
    p = A.table(s, d, "part").select(F.col("p_partkey").alias("machine_id"), F.lit("p").alias("provider"), F.col("p_name").alias("project_path"), F.when(F.col("p_partkey") % 2 == 0, F.sha1(F.col("p_name").cast("binary"))).alias("git_root_commit"))
    none = F.lit(None).cast("string")
    k = F.col("machine_id")
    old = p.select("*", F.when(k % 3 == 0, F.concat(F.lit("h.io/"), k.cast("string"))).alias("git_remote_url"), F.lit(False).alias("git_worktree"), none.alias("git_main_path"), F.lit("stale").alias("identity_key"))
    new = p.select("machine_id", "provider", "project_path", F.lit("no hash").alias("git_root_commit"), F.when(k % 3 == 1, F.concat(F.lit("git@h.io:"), k.cast("string"))).when(k % 3 == 0, "/local").alias("git_remote_url"), F.lit(None).cast("boolean").alias("git_worktree"), none.alias("git_main_path"))
    return ingest.upsert_projects(old, new).select("machine_id", "git_root_commit", "git_remote_url", "identity_key")


@query("d11_checked_aliases", "SELECT n_name AS project_path, CASE WHEN n_nationkey < 10 THEN 'AMERICA' ELSE r_name END AS identity_key FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    """Ten paths get another identity; a batch with a key that no project carries changes nothing."""
    p = A.projects(s, d)
    old = p.select(F.col("project_name").alias("project_path"), "identity_key")
    new = p.where("project_id < 10").select(F.col("project_name").alias("project_path"), F.lit("AMERICA").alias("identity_key"))
    try:
        old = ingest.set_aliases(old, new.withColumn("identity_key", F.lit("nobody's")), p)
    except ValueError:
        pass
    return ingest.set_aliases(old, new, p)


@query("j14_latest_or_none", "WITH t AS (SELECT o_orderkey AS tick_id, o_orderdate AS done_at, o_orderstatus AS outcome FROM orders) SELECT CAST(k AS INTEGER) AS k, (SELECT tick_id FROM t WHERE outcome = s ORDER BY done_at DESC, tick_id DESC LIMIT 1) AS tick_id FROM (VALUES (0, 'F'), (1, 'none')) v(k, s)")
def _(s, d):
    """The latest row of a status, and of one that no row has: one row each."""
    t = A.table(s, d, "orders")
    one = lambda k, status: t.where(F.col("o_orderstatus") == status).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("tick_id")).select(F.lit(k).alias("k"), "tick_id")
    return one(0, "F").unionByName(one(1, "none"))


# --- logs of one record a turn, one query a store

_TEXTS = {"uuid": "conv_id || '-' || turn", "ts": "1700000000 + turn * 60", "model": "'big'", "input_tokens": "length(text)", "output_tokens": "CAST(turn AS BIGINT)", "cache_read_tokens": "7"}


def _register_records(number: str, store: str) -> None:
    fields = logs.RECORDS[store]
    told = [n for n in _TEXTS if n in fields]
    place = "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq"
    sql = f"SELECT CAST(conv_id AS VARCHAR) AS session_id, {place}, role, text AS content, " + ", ".join(f"{_TEXTS[n]} AS {n if n != 'ts' else 'at'}" for n in told) + " FROM conversations"

    def run(s, d):
        rows, folder = _said(s, d), _folder(s, store)
        key = F.concat_ws("-", F.col("session_id").cast("string"), F.col("seq").cast("string"))
        values = {"uuid": key, "session_id": F.col("session_id").cast("string"), "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "model": F.lit("big"), "role": F.col("role"), "content": F.col("text"), "input_tokens": F.length("text"), "output_tokens": F.col("seq"), "cache_read_tokens": F.lit(7)}
        # a file is a session, as some stores name no other
        written.write_files(rows, folder, F.col("session_id").cast("string"), [F.col("seq")], written.record_line(fields, values))
        out = logs.chat_records(s, f"{folder}/*.jsonl", store, fields)
        return out.select("session_id", "seq", "role", "content", *[F.unix_seconds("ts").alias("at") if n == "ts" else F.col(n) for n in told])

    query(f"{number}_{store}_records", sql)(run)


for _number, _store in (("s05", "copilot_cli"), ("s07", "gemini"), ("s08", "qwen"), ("s09", "pi"), ("s11", "cursor_agent"), ("s12", "codebuddy")):
    _register_records(_number, _store)


@query("s02_rollout_counters", """WITH x AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
a AS (SELECT conv_id, turn, place - coalesce(lag(place) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS grown FROM x WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(place - 1 AS INTEGER) AS seq, role, text AS content, 'big' AS model, 7 * grown AS input_tokens, 2 * grown AS output_tokens, 3 * grown AS cache_read_tokens FROM x LEFT JOIN a USING (conv_id, turn)""")
def _(s, d):
    """Rollouts whose counters grow with the place (10 read, of these 3 from the cache, 2 written); counts follow assistants' answers."""
    rows, folder = _said(s, d), _folder(s, "rollout")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    rows = rows.withColumn("place", place)
    event = lambda kind, payload: F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(kind).alias("type"), payload.alias("payload")))
    start = F.when(F.col("place") == 1, F.array(event("session_meta", F.struct(F.col("session_id").cast("string").alias("id"))), event("turn_context", F.struct(F.lit("big").alias("model"))))).otherwise(F.array().cast("array<string>"))
    said = event("response_item", F.struct(F.lit("message").alias("type"), "role", F.col("text").alias("content")))
    total = F.struct(*[(F.col("place") * n).alias(k) for k, n in (("input_tokens", 10), ("cached_input_tokens", 3), ("output_tokens", 2))])
    count = event("event_msg", F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")))
    lines = F.concat(start, F.array(said), F.when(F.col("role") == "assistant", F.array(count)).otherwise(F.array().cast("array<string>")))
    each = rows.select("session_id", "seq", F.posexplode(lines).alias("n", "line"))
    written.write_files(each, folder, F.col("session_id").cast("string"), [F.col("seq"), F.col("n")], F.col("line"))
    out = logs.rollout(s, f"{folder}/*.jsonl")
    return out.select("session_id", "seq", "role", "content", "model", "input_tokens", "output_tokens", "cache_read_tokens")


@query("s27_event_directory", """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS seq, role, text || CASE WHEN next THEN chr(10) || 'seen ' || turn ELSE '' END AS content
FROM (SELECT *, turn % 2 = 0 AND EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = c.turn) AS next FROM conversations c)""")
def _(s, d):
    """Each turn as a file, and for every second one a file of what was observed, which names it as its cause."""
    rows, folder = _said(s, d), _folder(s, "events")
    action = F.to_json(F.struct(F.col("seq").alias("id"), F.col("role").alias("source"), F.lit("message").alias("action"), F.col("text").alias("message")))
    seen = F.to_json(F.struct((F.col("seq") + 100_000).alias("id"), F.lit("environment").alias("source"), F.lit("run").alias("observation"), F.col("seq").alias("cause"), F.concat(F.lit("seen "), F.col("seq").cast("string")).alias("content")))
    name = lambda n: F.concat(F.col("session_id").cast("string"), F.lit("/events/"), n.cast("string"))
    written.write_files(rows, folder, name(F.col("seq")), [F.col("seq")], action, suffix=".json")
    written.write_files(rows.where("seq % 2 = 0"), folder, name(F.col("seq") + 100_000), [F.col("seq")], seen, suffix=".json")
    out = logs.event_directory(s, f"{folder}/*/events/*.json")
    return out.where("role <> 'environment'").select("session_id", "seq", "role", "content")


def _tool_messages(s, d):
    """Lines of orders as messages: two tool uses and, in every second, a result; some by the message's own fields."""
    x = A.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("l_partkey").alias("part"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    own = F.col("l_linenumber") == 1
    uses = F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("a"), key).alias("id"), F.lit("Skill").alias("name"), F.struct(F.concat(F.lit("k"), (F.col("part") % 9).cast("string")).alias("skill")).alias("input")).alias("x")).getItem(0)
    agent = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("b"), key).alias("id"), F.lit("Agent").alias("name"), F.struct(F.lit("finder").alias("subagent_type")).alias("input")))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("a"), key).alias("tool_use_id"), (F.col("n") > 1).alias("is_error")))
    content = F.concat(F.lit("["), F.concat_ws(",", F.to_json(uses), agent, F.when(F.col("l_linenumber") % 2 == 0, result)), F.lit("]"))
    raw = F.to_json(F.struct(F.lit("assistant").alias("type"), F.when(F.col("part") % 3 == 0, "").otherwise(key).alias("messageId"), F.when(own, F.struct(F.lit("Bash").alias("name"), F.concat(F.lit("c"), key).alias("id"))).alias("toolUse")))
    return x.select(key.alias("id"), F.col("l_orderkey").alias("session_id"), F.lit("assistant").alias("type"), F.when(own, F.lit("[]")).otherwise(content).alias("content"), raw.alias("raw"))


_LINES_SQL = "WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS session_id, l_linenumber AS line, count(*) AS n, max(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber) "


@query("f20_tool_uses", _LINES_SQL + "SELECT id, session_id, 0 AS seq, 'Bash' AS tool_name, 'c' || id AS tool_use_id, NULL AS skill_name, NULL AS subagent_type FROM x WHERE line = 1 UNION ALL SELECT id, session_id, 0, 'Skill', 'a' || id, 'k' || part % 9, NULL FROM x WHERE line <> 1 UNION ALL SELECT id, session_id, 1, 'Agent', 'b' || id, NULL, 'finder' FROM x WHERE line <> 1")
def _(s, d):
    return extract.tool_uses(_tool_messages(s, d)).drop("is_error")


@query("f21_tool_results", _LINES_SQL + "SELECT id, session_id, 'a' || id AS tool_use_id, n > 1 AS is_error FROM x WHERE line % 2 = 0")
def _(s, d):
    return extract.tool_results(_tool_messages(s, d)).drop("seq")


@query("f19_message_ids", _LINES_SQL + "SELECT id, CASE WHEN part % 3 <> 0 THEN id END AS message_id FROM x")
def _(s, d):
    return _tool_messages(s, d).select("id", extract.message_id(F.col("raw")).alias("message_id"))


@query("f18_search_texts", "SELECT conv_id AS session_id, turn AS seq, trim(regexp_replace('note ' || text || ' deep ' || text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS found FROM conversations")
def _(s, d):
    """Strings of nested values, not those of keys that only structure a message."""
    inner = F.struct(F.lit("no").alias("type"), F.lit("no").alias("id"), F.array(F.struct(F.lit("deep").alias("a"), F.col("text").alias("b"))).alias("list"))
    said = F.to_json(F.struct(F.lit("no").alias("role"), F.lit("note").alias("k"), F.col("text").alias("t"), F.lit(5).alias("n"), inner.alias("x")))
    return extract.search_text(A.turns(s, d).withColumn("json", said), "json", "found").select("session_id", "seq", "found")


@query("f27_usage", "SELECT l_orderkey AS k, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN NULL ELSE 8 END AS input_tokens, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 9 ELSE NULL END AS output_tokens, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    """Usage of the message itself (of which one count is missing), of its tool's result, as a total of an assistant's, of its content."""
    k = F.col("l_linenumber") % 4
    of = lambda t: F.lit(t)
    raw = F.when(k == 0, of('{"type":"user","message":{"usage":{"input_tokens":5}},"toolUseResult":{"usage":{"output_tokens":99}}}')).when(k == 1, of('{"toolUseResult":{"usage":{"input_tokens":6}},"content":{"usage":{"input_tokens":77,"output_tokens":1}}}')).when(k == 2, of('{"type":"assistant","toolUseResult":{"totalTokens":9}}')).otherwise(of('{"type":"user","toolUseResult":{"totalTokens":8}}'))
    # lines alike say the same, so they are counted before their message is read
    x = A.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    x = x.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), extract.usage_struct(raw, ("input_tokens", "output_tokens")).alias("u"), "n")
    return x.select("k", "line", "u.input_tokens", "u.output_tokens", "n")


@query("f36_transcripts", """WITH l AS (SELECT conv_id AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM conversations WHERE turn % 5 <> 4 AND regexp_matches(text, '\\S') GROUP BY 1)
SELECT session_id, CASE WHEN length(t) <= 900 THEN t ELSE substr(t, 1, 540) || chr(10) || chr(10) || '[... transcript truncated ...]' || chr(10) || chr(10) || right(t, 360) END AS transcript FROM l""")
def _(s, d):
    return transcripts.transcripts(A.turns(s, d).withColumn("is_sidechain", F.col("seq") % 5 == 4), 900)


@query("a29_current_streaks", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 = 0), i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT user_id, count(*) AS days, max(day) AS last_day FROM i GROUP BY user_id, island)
SELECT user_id, max(days) AS longest, CASE WHEN max(last_day) BETWEEN DATE '2024-01-28' AND DATE '2024-01-29' THEN arg_max(days, last_day) ELSE 0 END AS current FROM r WHERE last_day <= DATE '2024-01-29' GROUP BY 1""")
def _(s, d):
    """As of 29 January; days after it are in no run that ends by then."""
    days = A.table(s, d, "events").where("event_id % 3 = 0").select("user_id", F.to_date("ts").alias("day"))
    ends = days.distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    islands = ends.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    whole = islands.groupBy("user_id", "island").agg(F.max("day").alias("last")).where("last <= date '2024-01-29'").select("user_id", "island")
    past = islands.join(whole, ["user_id", "island"]).select("user_id", "day")
    return sequences.current_streaks(past, "user_id", "2024-01-29").select("user_id", "longest", "current")


@query("d14_merge_modes", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT 'ignore' AS mode, id, v FROM o UNION ALL SELECT 'ignore', id, v FROM n WHERE id % 3 = 0 UNION ALL SELECT 'replace', id, v FROM o WHERE id % 2 = 1 UNION ALL SELECT 'replace', id, v FROM n UNION ALL SELECT 'full', id, v FROM n""")
def _(s, d):
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    old, new = o.where("id % 3 <> 0"), o.where("id % 2 = 0").withColumn("v", F.lit("new"))
    modes = [refresh.merged(old, new.unionByName(new), m).select(F.lit(m).alias("mode"), "id", "v") for m in ("ignore", "replace", "full")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("s09_headed_logs", "SELECT 'sess-' || conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role, text AS content, '/work/' || conv_id % 7 AS cwd FROM conversations")
def _(s, d):
    """Files whose first record names session and folder, which all their messages have."""
    rows, folder = _said(s, d), _folder(s, "headed")
    session = F.concat(F.lit("sess-"), F.col("session_id").cast("string"))
    head = F.to_json(F.struct(F.lit("session").alias("type"), session.alias("id"), F.concat(F.lit("/work/"), (F.col("session_id") % 7).cast("string")).alias("cwd")))
    message = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    heads = rows.select("session_id").distinct().select("session_id", F.lit(-1).cast("long").alias("seq"), head.alias("line"))
    both = heads.unionByName(rows.select("session_id", "seq", message.alias("line")))
    written.write_files(both, folder, F.col("session_id").cast("string"), [F.col("seq")], F.col("line"))
    return logs.headed_records(s, f"{folder}/*.jsonl").select("session_id", "seq", "role", "content", "cwd")


@query("s34_enabled_providers", f"WITH {A.MESSAGES} SELECT provider, count(*) AS n FROM messages WHERE provider IN ('click', 'view') GROUP BY 1")
def _(s, d):
    """Messages stored by provider; only the enabled ones' folders are read."""
    store = Snapshots(s, _folder(s, "by-provider"), ["provider"])
    store.rebuild(lambda: A.messages(s, d))
    reader = lambda name: lambda: store.read().where(F.col("provider") == name)
    readers = {name: reader(name) for name in ("click", "view", "purchase", "error", "signup")}
    return logs.chosen(readers, exclude=["purchase", "error", "signup"]).groupBy("provider").agg(F.count("*").alias("n"))
