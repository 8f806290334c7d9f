"""Readers of conversation logs: each gives the normalized message columns of schemas.MESSAGE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions import extract

from .small import small_files

MESSAGE = ["provider", "session_id", "seq", "uuid", "parent_uuid", "ts", "type", "role", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "content", "raw"]


def _j(path: str, col: str = "value") -> Column:
    return F.get_json_object(col, path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a number that follows their place in it."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _numbered(rows: DataFrame) -> DataFrame:
    """seq: the place among a session's kept rows."""
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("session_id").orderBy("block", "line")) - 1).cast("int"))


def _finish(rows: DataFrame, provider: str, *more: str) -> DataFrame:
    have = {"provider": F.lit(provider)} | {c: F.col(c) for c in rows.columns}
    kinds = {"seq": "int", "ts": "timestamp"} | {c: "long" for c in MESSAGE if c.endswith("tokens")}
    return rows.select(*[have.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in MESSAGE], *more)


def canonical(spark: SparkSession, path: str, provider: str = "claude") -> DataFrame:
    """Append-only JSONL: lines that are no JSON are dropped, summaries too, and rows with neither session nor time."""
    return canonical_lines(_lines(spark, path), provider)


def canonical_lines(rows: DataFrame, provider: str = "claude") -> DataFrame:
    """canonical() of lines (file, block, line, value) that were read before; block and line give their order in a file."""
    rows = rows.where(_j("$.type").isNotNull() & (_j("$.type") != "summary"))
    rows = rows.where(_j("$.sessionId").isNotNull() | _j("$.timestamp").isNotNull())
    rows = rows.select(
        "block",
        "line",
        F.coalesce(_j("$.sessionId"), F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)).alias("session_id"),
        _j("$.uuid").alias("uuid"),
        _j("$.parentUuid").alias("parent_uuid"),
        F.try_to_timestamp(_j("$.timestamp")).alias("ts"),
        _j("$.type").alias("type"),
        _j("$.message.role").alias("role"),
        _j("$.message.model").alias("model"),
        F.coalesce(_j("$.message.content"), _j("$.content")).alias("content"),
        F.col("value").alias("raw"),
        *[c.alias(n) for n, c in extract.usage(F.col("value")).items()],
    )
    return _finish(_numbered(rows), provider)


def rollout(spark: SparkSession, path: str, provider: str = "codex") -> DataFrame:
    """Rollout JSONL with cumulative counters: a count's growth goes to the last assistant message before it.

    The first event of a file brings its totals; input is what was not read from the cache.
    """
    rows = _lines(spark, path)
    order = Window.partitionBy("file").orderBy("block", "line")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    kind, payload = _j("$.type"), _j("$.payload.type")
    rows = rows.select(
        "*",
        F.last(F.when(kind == "session_meta", _j("$.payload.id")), ignorenulls=True).over(past).alias("session_id"),
        F.last(F.when(kind == "turn_context", _j("$.payload.model")), ignorenulls=True).over(past).alias("model"),
        kind.alias("kind"),
        payload.alias("payload"),
    )
    said = F.when((F.col("kind") == "response_item") & (F.col("payload") == "message"), F.struct("block", "line"))
    rows = rows.withColumn("answer", F.last(F.when(_j("$.payload.role") == "assistant", said), ignorenulls=True).over(past))
    counts = rows.where("kind = 'event_msg' and payload = 'token_count'")
    total = lambda k: F.coalesce(_j(f"$.payload.info.total_token_usage.{k}").try_cast("long"), F.lit(0))
    counts = counts.select("file", "block", "line", "answer", total("input_tokens").alias("i"), total("cached_input_tokens").alias("c"), total("output_tokens").alias("o"))
    grown = {c: F.greatest(F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0)), F.lit(0)) for c in "ico"}
    counts = counts.select("file", "answer", *[e.alias(f"d{c}") for c, e in grown.items()]).where("answer is not null")
    per = counts.groupBy("file", "answer").agg(F.sum(F.greatest(F.col("di") - F.col("dc"), F.lit(0))).alias("input_tokens"), F.sum("do").alias("output_tokens"), F.sum("dc").alias("cache_read_tokens"))
    messages = rows.where("kind = 'response_item' and payload = 'message'").withColumn("self", F.struct("block", "line"))
    per = per.select(F.col("file").alias("_file"), F.col("answer").alias("_answer"), "input_tokens", "output_tokens", "cache_read_tokens")
    out = messages.join(per, (F.col("file") == F.col("_file")) & (F.col("self") == F.col("_answer")), "left")
    role = _j("$.payload.role")
    out = out.select("block", "line", "session_id", "model", F.try_to_timestamp(_j("$.timestamp")).alias("ts"), role.alias("type"), role.alias("role"), _j("$.payload.content").alias("content"), F.col("value").alias("raw"), "input_tokens", "output_tokens", "cache_read_tokens")
    return _finish(_numbered(out), provider)


def headed_records(spark: SparkSession, path: str, provider: str = "pi") -> DataFrame:
    """Messages of files whose header record (type session) names the session and its folder, with cwd.

    A file's first header counts for all its messages (type message); without one the file names the session.
    """
    rows = _lines(spark, path).where(F.try_parse_json("value").isNotNull())
    place = F.struct("block", "line")
    head = rows.where(_j("$.type") == "session").groupBy(F.col("file").alias("_f")).agg(F.min_by(F.struct(_j("$.id").alias("id"), _j("$.cwd").alias("cwd")), place).alias("_head"))
    rows = rows.where(_j("$.type") == "message").join(head, F.col("file") == F.col("_f"), "left")
    named = rows.withColumn("session_id", F.coalesce("_head.id", F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1)))
    cwds = named.groupBy(F.col("session_id").alias("_s")).agg(F.max("_head.cwd").alias("cwd"))
    out = _chat(named, provider, RECORDS[provider] | {"session_id": None})
    return out.join(cwds, F.col("session_id") == F.col("_s"), "left").drop("_s")


def chat_records(spark: SparkSession, path: str, provider: str, fields: dict[str, str], times_of_files: bool = False) -> DataFrame:
    """JSONL of one record a turn; fields names the JSON path of each message column (session_id defaults to the file).

    Stores that write no times may have those of their files.
    """
    return _chat(_lines(spark, path).where(F.try_parse_json("value").isNotNull()), provider, fields, times_of_files)


def _chat(rows: DataFrame, provider: str, fields: dict[str, str | None], times_of_files: bool = False) -> DataFrame:
    """chat_records() of lines; a field without path is a column of theirs."""
    cols = {k: _j(p) if p else F.col(k) for k, p in fields.items()}
    cols["session_id"] = F.coalesce(cols.get("session_id", F.lit(None).cast("string")), F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1))
    if "ts" in cols:
        cols["ts"] = F.try_to_timestamp(cols["ts"])
    if times_of_files:
        cols["ts"] = F.coalesce(cols.get("ts", F.lit(None).cast("timestamp")), "modified")
    for c in cols:
        if c.endswith("tokens"):
            n = cols[c].try_cast("long")
            cols[c] = F.when(n < 0, 0).otherwise(n)  # unknown stays null
    rows = rows.select("block", "line", F.col("value").alias("raw"), *[c.alias(k) for k, c in cols.items()])
    return _finish(_numbered(rows), provider)


# Where each store keeps what.
RECORDS = {
    "qwen": {"uuid": "$.uuid", "parent_uuid": "$.parentUuid", "session_id": "$.sessionId", "ts": "$.timestamp", "type": "$.type", "role": "$.type", "model": "$.model", "content": "$.message.parts", "input_tokens": "$.usageMetadata.promptTokenCount", "output_tokens": "$.usageMetadata.candidatesTokenCount", "cache_read_tokens": "$.usageMetadata.cachedContentTokenCount"},
    "pi": {"uuid": "$.id", "parent_uuid": "$.parentId", "ts": "$.timestamp", "type": "$.type", "role": "$.message.role", "model": "$.message.model", "content": "$.message.content", "input_tokens": "$.message.usage.input", "output_tokens": "$.message.usage.output", "cache_creation_tokens": "$.message.usage.cacheWrite", "cache_read_tokens": "$.message.usage.cacheRead"},
    "gemini": {"uuid": "$.id", "ts": "$.timestamp", "type": "$.type", "role": "$.type", "model": "$.model", "content": "$.content", "input_tokens": "$.tokens.input", "output_tokens": "$.tokens.output", "cache_read_tokens": "$.tokens.cached"},
    "codebuddy": {"uuid": "$.id", "session_id": "$.sessionId", "ts": "$.timestamp", "type": "$.role", "role": "$.role", "content": "$.content"},
    "cursor_agent": {"type": "$.role", "role": "$.role", "content": "$.message.content"},
    "kimi": {"type": "$.role", "role": "$.role", "content": "$.content"},
    "copilot_cli": {"uuid": "$.id", "parent_uuid": "$.parentId", "ts": "$.timestamp", "type": "$.type", "role": "$.data.role", "content": "$.data.content", "output_tokens": "$.data.outputTokens"},
}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def markdown(spark: SparkSession, path: str, provider: str = "aider") -> DataFrame:
    """Markdown history: a header line with a time starts a session, lines that start with #### are user turns."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    head = r"(?m)^# .*?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}).*$"
    times = F.regexp_extract_all("value", F.lit(head), F.lit(1))
    parts = F.slice(F.split("value", head), 2, 1_000_000)
    rows = files.select("file", F.explode(F.arrays_zip(times.alias("t"), parts.alias("p"))).alias("s"))
    rows = rows.select(F.concat_ws("#", "file", "s.t").alias("session_id"), F.try_to_timestamp("s.t").alias("ts"), F.col("s.p").alias("p"))
    turns = F.slice(F.split("p", r"(?m)^#### "), 2, 1_000_000)
    rows = rows.select("session_id", "ts", F.posexplode(turns).alias("n", "t"))
    user, answer = _strip(F.regexp_extract("t", r"^([^\n]*)", 1)), _strip(F.regexp_replace("t", r"^[^\n]*\n?", ""))
    both = F.array(F.struct(F.lit("user").alias("role"), user.alias("content"), (F.col("n") * 2).alias("seq")), F.struct(F.lit("assistant").alias("role"), answer.alias("content"), (F.col("n") * 2 + 1).alias("seq")))
    rows = rows.select("session_id", "ts", F.explode(both).alias("m")).select("session_id", "ts", "m.*").withColumn("type", F.col("role"))
    return _finish(rows, provider)


def event_directory(spark: SparkSession, path: str, provider: str = "openhands") -> DataFrame:
    """One JSON file an event; an observation is joined to the action that it names as its cause."""
    rows = small_files(spark, path).select("value", F.regexp_extract("file", r"([^/]+)/events/[^/]+$", 1).alias("session_id"))
    rows = rows.select("session_id", _j("$.id").cast("long").alias("seq"), F.try_to_timestamp(_j("$.timestamp")).alias("ts"), _j("$.source").alias("role"), F.coalesce(_j("$.action"), _j("$.observation")).alias("type"), _j("$.cause").cast("long").alias("cause"), F.coalesce(_j("$.message"), _j("$.content")).alias("content"), F.col("value").alias("raw"))
    seen = rows.where("cause is not null").groupBy(F.col("session_id").alias("_s"), F.col("cause").alias("_c")).agg(F.min_by("content", "seq").alias("observed"))
    out = rows.join(seen, (F.col("session_id") == F.col("_s")) & (F.col("seq") == F.col("_c")), "left")
    return _finish(out.withColumn("content", F.concat_ws("\n", "content", "observed")), provider)


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of hash|author|seconds|subject."""
    p = F.split("value", r"\|", 4)
    return spark.read.text(path).where(F.size(p) == 4).select(p[0].alias("commit_id"), p[1].alias("author"), F.timestamp_seconds(p[2].try_cast("long")).alias("committed_at"), p[3].alias("subject"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, data): one JSON document a file, named by it."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("session_id"), F.col("value").alias("data"))


def document_turns(documents: DataFrame, provider: str, array_path: str, fields: dict[str, str]) -> DataFrame:
    """Turns of (session_id, data) documents that hold them in one array; fields as in chat_records.

    Documents without the array have no turns. Serves stores of one file a session and values of
    SQLite stores alike.
    """
    arr = F.from_json(F.get_json_object("data", array_path), "array<string>")
    rows = documents.select("session_id", F.posexplode(arr).alias("seq", "value"))
    cols = {k: _j(p) for k, p in fields.items()}
    if "ts" in cols:
        millis = F.timestamp_millis(cols["ts"].try_cast("long"))
        cols["ts"] = F.coalesce(millis, F.try_to_timestamp(cols["ts"]))
    for c in cols:
        if c.endswith("tokens"):
            n = cols[c].try_cast("long")
            cols[c] = F.when(n < 0, 0).otherwise(n)
    return _finish(rows.select("session_id", "seq", F.col("value").alias("raw"), *[c.alias(k) for k, c in cols.items()]), provider)


# The array of a store's documents, and where its turns keep what.
DOCUMENTS = {
    "continue": ("$.history", {"type": "$.message.role", "role": "$.message.role", "content": "$.message.content"}),
    "cline": ("$.messages", {"ts": "$.ts", "type": "$.role", "role": "$.role", "content": "$.content"}),
    "opencode": ("$.messages", {"uuid": "$.id", "ts": "$.time.created", "type": "$.role", "role": "$.role", "model": "$.modelID", "content": "$.parts", "input_tokens": "$.tokens.input", "output_tokens": "$.tokens.output", "cache_creation_tokens": "$.tokens.cache.write", "cache_read_tokens": "$.tokens.cache.read"}),
    "zed": ("$.messages", {"uuid": "$.id", "type": "$.role", "role": "$.role", "content": "$.segments"}),
    "amazonq": ("$.history", {"type": "$.role", "role": "$.role", "content": "$.content"}),
    "forgecode": ("$.messages", {"type": "$.role", "role": "$.role", "content": "$.content", "input_tokens": "$.usage.prompt_tokens", "output_tokens": "$.usage.completion_tokens"}),
    "trae": ("$.messages", {"uuid": "$.id", "ts": "$.timestamp", "type": "$.role", "role": "$.role", "content": "$.content"}),
}
# stores that share another's shape
DOCUMENTS |= {"pearai": DOCUMENTS["continue"], "kiro": DOCUMENTS["amazonq"], "cursor": DOCUMENTS["trae"], "goose": DOCUMENTS["amazonq"], "crush": DOCUMENTS["amazonq"]}


def usage_records(spark: SparkSession, path: str) -> DataFrame:
    """Usage lines (recordType usage): all four counts are always set."""
    rows = spark.read.text(path).where(_j("$.recordType") == "usage")
    counts = {c: F.coalesce(_j(f"$.{k}").try_cast("long"), F.lit(0)) for c, k in (("input_tokens", "inputTokens"), ("output_tokens", "outputTokens"), ("cache_creation_tokens", "cacheCreationTokens"), ("cache_read_tokens", "cacheReadTokens"))}
    return rows.select(_j("$.sessionId").alias("session_id"), _j("$.model").alias("model"), F.try_to_timestamp(_j("$.timestamp")).alias("ts"), *[e.alias(c) for c, e in counts.items()])


def chosen(readers: dict[str, Callable[[], DataFrame]], only: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """Messages of the providers that are asked for and not excluded; the others' stores are never touched."""
    names = [n for n in readers if (only is None or n in only) and n not in exclude]
    if unknown := [n for n in [*(only or []), *exclude] if n not in readers]:
        raise ValueError(f"unknown providers {unknown}")
    if not names:
        raise ValueError("no provider is left")
    return union_of(*[readers[n]() for n in names])


def union_of(*providers: DataFrame) -> DataFrame:
    """One frame of several providers' messages; a provider that is not asked for is simply not passed, and never read."""
    out = providers[0]
    for p in providers[1:]:
        out = out.unionByName(p)
    return out
