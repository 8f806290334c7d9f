"""Sessions that are spread over several files of a directory, joined by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions import blocks as B

from .logs import _finish
from .small import small_files


def _folder(depth: int = 1, col: str = "file") -> Column:
    """The path of the folder `depth` levels above a file."""
    return F.regexp_extract(col, "^(.*)" + "/[^/]+" * depth + "$", 1)


def _named(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/?$", 1)



def _files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Documents (folder, file, value) called name below path."""
    return small_files(spark, f"{path}/**/{name}").select("file", "modified", "value").withColumn("folder", _folder())


def _records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON lines (folder, block, line, v) of files called name below path; other lines are left out."""
    rows = small_files(spark, f"{path}/**/{name}", lines=True).where("trim(value) <> ''")
    return rows.select(_folder().alias("folder"), "file", "modified", F.lit(0).alias("block"), "line", "value", F.try_parse_json("value").alias("v")).where("v is not null")


def _wire_times(spark: SparkSession, path: str) -> DataFrame:
    """First and last time of each session's wire log, by the order of its lines; times outside 1970 to 2100 don't count."""
    rows = _records(spark, path, "wire.jsonl").select("folder", "block", "line", F.try_variant_get("v", "$.timestamp", "double").alias("s")).where("s between 0 and 4102444800")
    place = F.struct("block", "line")
    return rows.groupBy(F.col("folder").alias("_w")).agg(F.min_by("s", place).cast("timestamp").alias("first"), F.max_by("s", place).cast("timestamp").alias("last"))


def _content_blocks(v: Column) -> Column:
    """A context record's content as blocks in JSON (an array of strings): thoughts under their usual name."""
    think = lambda b: B.string(b, "$.type") == "think"
    named = lambda b: F.when(think(b), F.to_json(F.struct(F.lit("thinking").alias("type"), F.coalesce(B.string(b, "$.think"), F.lit("")).alias("thinking")))).otherwise(F.to_json(b))
    text = F.coalesce(B.string(v, "$.content"), F.when(B.kind(B.at(v, "$.content")).isin("VOID", ""), None).otherwise(F.to_json(B.at(v, "$.content"))))
    single = F.when(text.isNotNull(), F.array(F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))))
    return F.when(B.kind(B.at(v, "$.content")) == "ARRAY", F.transform(B.items(v, "$.content"), named)).otherwise(F.coalesce(single, F.array().cast("array<string>")))


def _call(c: Column) -> Column:
    """A tool call as a block in JSON; arguments that are JSON in a string are read."""
    said = F.coalesce(B.string(c, "$.function.arguments"), B.string(c, "$.arguments"))
    plain = F.to_json(F.struct(said.alias("input")))
    given = F.coalesce(F.when(said.isNotNull(), F.coalesce(F.to_json(F.try_parse_json(said)), plain)), F.to_json(B.at(c, "$.function.arguments")), F.to_json(B.at(c, "$.arguments")), F.lit("null"))
    name = F.coalesce(B.string(c, "$.function.name"), B.string(c, "$.name"), F.lit("tool"))
    head = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.coalesce(B.string(c, "$.id"), F.lit("")).alias("id"), name.alias("name")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"input":'), given, F.lit("}"))


def context_messages(spark: SparkSession, path: str, provider: str = "kimi") -> DataFrame:
    """Messages of session folders with context.jsonl, times by their wire.jsonl.

    Records of roles that begin with _ are no messages; user, assistant and tool are. A message without id is named after
    its folder and place. All carry the session's first time on the wire, else the time of the file.
    """
    rows = _records(spark, path, "context.jsonl").withColumn("role", F.coalesce(B.string(F.col("v"), "$.role"), F.lit(""))).where("not startswith(role, '_')")
    order = Window.partitionBy("folder").orderBy("block", "line")
    rows = rows.withColumn("count", F.row_number().over(order)).where(F.col("role").isin("user", "assistant", "tool"))
    v, session = F.col("v"), _named(F.col("folder"))
    calls = F.when(F.col("role") == "assistant", F.transform(B.items(v, "$.tool_calls"), _call)).otherwise(F.array().cast("array<string>"))
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":'), F.to_json(F.array(F.coalesce(B.string(v, "$.tool_call_id"), F.lit("")))), F.lit(',"content":'), F.coalesce(F.to_json(B.at(v, "$.content")), F.lit("null")), F.lit("}"))
    result = F.regexp_replace(result, r'"tool_use_id":\[(.*?)\],"content":', '"tool_use_id":$1,"content":')
    found = F.when(F.col("role") == "tool", F.array(result)).otherwise(F.concat(_content_blocks(v), calls))
    times = _wire_times(spark, path)
    out = rows.join(times, F.col("folder") == F.col("_w"), "left").select(
        session.alias("session_id"),
        (F.row_number().over(order) - 1).cast("int").alias("seq"),
        F.coalesce(B.string(v, "$.id"), F.concat(session, F.lit("-"), F.col("count").cast("string"))).alias("uuid"),
        F.coalesce("first", "modified").alias("ts"),
        F.col("role").alias("type"),
        "role",
        F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")).alias("content"),
        F.col("value").alias("raw"),
    )
    return _finish(out, provider)


def context_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row a session folder with messages: count, tool use, times by its wire.jsonl, summary: the title of its state.json, else the first user's text."""
    rows = _records(spark, path, "context.jsonl")
    v, role = F.col("v"), B.string(F.col("v"), "$.role")
    place = F.struct("block", "line")
    said = F.array_join(F.filter(F.transform(B.items(v, "$.content"), lambda b: B.string(b, "$.text")), lambda t: t.isNotNull()), " ")
    text = F.coalesce(B.string(v, "$.content"), F.nullif(said, F.lit("")))
    user = F.when((role == "user") & text.isNotNull(), place)
    per = rows.groupBy("folder").agg(
        F.count(F.when(role.isin("user", "assistant", "tool"), 1)).alias("message_count"),
        F.coalesce(F.bool_or((role == "tool") | (~F.startswith(role, F.lit("_")) & (F.size(B.items(v, "$.tool_calls")) > 0))), F.lit(False)).alias("has_tool_use"),
        F.min_by(text, user).alias("first_user"),
        F.max("modified").alias("modified"),
    )
    title = F.nullif(F.trim(B.string(F.try_parse_json("value"), "$.custom_title")), F.lit(""))
    state = _files(spark, path, "state.json").select(F.col("folder").alias("_s"), title.alias("title"))
    out = per.where("message_count > 0").join(state, F.col("folder") == F.col("_s"), "left").join(_wire_times(spark, path), F.col("folder") == F.col("_w"), "left")
    return out.select(_named(F.col("folder")).alias("session_id"), "message_count", "has_tool_use", F.col("first").alias("first_message_time"), F.coalesce("last", "first").alias("last_message_time"), F.coalesce("last", "first", "modified").alias("last_modified"), F.coalesce("title", "first_user").alias("summary"))


def storage_messages(spark: SparkSession, base: str, provider: str = "opencode") -> DataFrame:
    """Messages kept as storage/message/<session>/<id>.json with their parts as storage/part/<id>/<part>.json.

    Content is the parts in the order of their names; a message without token counts or cost of its own has the sums of
    its steps' (a count that no step has stays null).
    """
    m = _files(spark, f"{base}/storage/message", "*.json").withColumn("v", F.try_parse_json("value")).where("v is not null")
    v = F.col("v")
    count = lambda p: F.try_variant_get("v", p, "long")
    m = m.select(_named(F.col("folder")).alias("session_id"), F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("uuid"), "value", "v")
    p = _files(spark, f"{base}/storage/part", "*.json").withColumn("v", F.try_parse_json("value")).where("v is not null")
    step = B.string(v, "$.type") == "step-finish"
    cost = F.try_variant_get("v", "$.cost", "double")
    parts = p.groupBy(_named(F.col("folder")).alias("_m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda x: x["value"]).alias("parts"),
        *[F.sum(F.when(step, count(f"$.tokens.{k}"))).alias(f"_{n}") for n, k in (("in", "input"), ("out", "output"), ("write", "cache.write"), ("read", "cache.read"))],
        F.bool_or(step & B.at(v, "$.tokens").isNotNull()).alias("_counted"),
        F.sum(F.when(step & (cost > 0), cost)).alias("_cost"),
    )
    own = B.at(v, "$.tokens").isNotNull()
    pick = lambda path, column: F.when(own, count(path) if path else F.lit(None).cast("long")).otherwise(F.col(column))
    role = F.coalesce(B.string(v, "$.role"), F.lit("user"))
    order = Window.partitionBy("session_id").orderBy("ts", "uuid")
    out = m.join(parts, F.col("uuid") == F.col("_m"), "left").select(
        "session_id",
        "uuid",
        B.string(v, "$.parentID").alias("parent_uuid"),
        F.timestamp_millis(F.try_variant_get("v", "$.time.created", "long")).alias("ts"),
        F.when(role.isin("assistant", "system"), role).otherwise("user").alias("type"),
        role.alias("role"),
        B.string(v, "$.modelID").alias("model"),
        F.concat(F.lit("["), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), ","), F.lit("]")).alias("content"),
        F.col("value").alias("raw"),
        pick("$.tokens.input", "_in").alias("input_tokens"),
        pick("$.tokens.output", "_out").alias("output_tokens"),
        pick(None, "_write").alias("cache_creation_tokens"),
        pick(None, "_read").alias("cache_read_tokens"),
        F.coalesce(F.try_variant_get("v", "$.cost", "double"), "_cost").alias("cost_usd"),
    )
    out = out.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
    # cost is no column of MESSAGE; beside it the rows pass once
    return _finish(out, provider, "cost_usd")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Sub-agents' transcripts (agent-<id>.jsonl) with the tool use that spawned them, by first time.

    The spawning id is in a sibling agent-<id>.meta.json; null where there is none, or it says none. The summary is the
    beginning of the first user's text; lines that are no JSON count as messages.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.jsonl").text(path).where("trim(value) <> ''")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("l")).alias("at"), F.try_parse_json("value").alias("v"))
    v = F.col("v")
    time = B.string(v, "$.timestamp")
    text = F.coalesce(B.string(v, "$.message.content"), F.get(F.filter(F.transform(B.items(v, "$.message.content"), lambda b: B.string(b, "$.text")), lambda t: t.isNotNull()), 0))
    said = F.when((B.string(v, "$.type") == "user") & (B.string(v, "$.message.role") == "user") & text.isNotNull(), F.col("at"))
    per = lines.groupBy("file").agg(F.count("*").alias("message_count"), F.max("file_size").alias("file_size"), F.min_by(time, F.when(time.isNotNull(), F.col("at"))).alias("first_message_time"), F.max_by(time, F.when(time.isNotNull(), F.col("at"))).alias("last_message_time"), F.substring(F.min_by(text, said), 1, 100).alias("summary"))
    stem = lambda c, end: F.regexp_extract(c, r"^(.*)" + end + "$", 1)
    meta = _files(spark, path, "agent-*.meta.json").select(stem("file", r"\.meta\.json").alias("_stem"), F.nullif(B.string(F.try_parse_json("value"), "$.toolUseId"), F.lit("")).alias("tool_use_id"))
    out = per.withColumn("stem", stem("file", r"\.jsonl")).join(meta, F.col("stem") == F.col("_stem"), "left")
    agent = F.regexp_replace(_named(F.col("stem")), "^agent-", "")
    return out.select(agent.alias("agent_id"), F.col("file").alias("file_path"), "message_count", "file_size", "first_message_time", "last_message_time", "summary", "tool_use_id").orderBy(F.asc_nulls_first("first_message_time"), "agent_id")
