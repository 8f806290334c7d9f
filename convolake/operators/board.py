"""Session board, desktop-mode statistics, costs and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.tables import cut


def calendar(days: DataFrame, value: str) -> DataFrame:
    """Every day from the first to the last with its value, zero where there was none."""
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    all_days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return all_days.join(days, "day", "left").select("day", F.coalesce(value, F.lit(0)).alias(value))


def growth(days: DataFrame, value: str) -> DataFrame:
    """Day-over-day change in whole percent; 0 after a day of none. One row a day, so one ordered window is small."""
    before = F.lag(value).over(Window.orderBy("day"))
    pct = F.when(F.coalesce(before, F.lit(0)) == 0, 0).otherwise(F.round((F.col(value) - before) * 100.0 / before))
    return days.select("day", value, pct.cast("long").alias("growth_percent"))


def week_grid(days: DataFrame, value: str) -> DataFrame:
    """Days on Sunday-aligned weeks with their share of the busiest day."""
    top = days.agg(F.max(value).alias("top"))
    dow = F.dayofweek("day") - 1
    return days.crossJoin(top).select("day", F.date_sub("day", dow).alias("week"), dow.alias("dow"), F.round(F.col(value) / F.col("top"), 6).alias("intensity"))


def costs(usage: DataFrame, prices: DataFrame, default: dict[str, float]) -> DataFrame:
    """Cost of model usage by the price whose key is the longest part of the model's name.

    Prices are a table of a few dozen rows; usage is one row a model, so their product is small.
    """
    p = prices.withColumnRenamed("model", "price_key")
    hit = usage.join(F.broadcast(p), F.contains(F.col("model"), F.col("price_key")), "left")
    w = Window.partitionBy("model").orderBy(F.length("price_key").desc_nulls_last(), "price_key")
    one = hit.withColumn("r", F.row_number().over(w)).where("r = 1")
    cost = (F.col("input_tokens") * F.coalesce("input_rate", F.lit(default["input"])) + F.col("output_tokens") * F.coalesce("output_rate", F.lit(default["output"]))) / 1e6
    return one.select("model", "total_tokens", F.round(cost, 6).alias("cost"), F.col("price_key").isNotNull().alias("priced"))


def coverage(costed: DataFrame) -> DataFrame:
    priced = F.coalesce(F.sum(F.when(F.col("priced"), F.col("total_tokens"))), F.lit(0))
    return costed.agg(F.round(F.sum("cost"), 6).alias("cost"), F.round(priced / F.greatest(F.coalesce(F.sum("total_tokens"), F.lit(0)), F.lit(1)), 6).alias("coverage"))


# Kinds of messages, in the words of the logs.
CORE_KINDS, CONVERSATION_KINDS = ("user", "assistant", "system"), ("user", "assistant")


def stats_mode(mode: str | None, kind: str = "kind") -> Column:
    """Which messages (kind, provider, is_sidechain, has_usage) a mode of statistics counts.

    conversation_only: turns of user and assistant outside sidechains. billing_total, also where the mode
    is unknown: core messages, and others if they carry usage. Summaries never count, nor do prompts that
    antigravity makes up (a user's, without usage).
    """
    k, usage = F.col(kind), F.coalesce("has_usage", F.lit(False))
    made_up = F.coalesce(F.col("provider") == "antigravity", F.lit(False)) & (k == "user") & ~usage
    if mode == "conversation_only":
        counts = k.isin(*CONVERSATION_KINDS) & ~F.coalesce("is_sidechain", F.lit(False))
    else:
        counts = (k != "summary") & (k.isin(*CORE_KINDS) | usage)
    return counts & ~made_up


def desktop_daily(scope: DataFrame) -> DataFrame:
    """Daily rows as the desktop counts them: every stored row is a message, usage once, hours guessed from messages."""
    return scope.where("ts is not null").groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("messages"),
        F.countDistinct("session_id").alias("sessions"),
        F.coalesce(F.sum(F.when(F.col("usage_row"), F.col("tokens"))), F.lit(0)).alias("total_tokens"),
        F.least(F.greatest(F.floor(F.count("*") / 10), F.lit(1)), F.lit(24)).cast("long").alias("active_hours"),
    )


def desktop_tools(uses: DataFrame) -> DataFrame:
    """Success by the invocation's own flag, in percent."""
    ok = F.count(F.when(~F.coalesce("is_error", F.lit(False)), 1))
    return uses.where("tool_name is not null").groupBy("tool_name").agg(F.count("*").alias("uses"), F.round(ok * 100.0 / F.count("*"), 6).alias("success_rate"))


# Kinds of tools by their exact names, then by words in their names.
TOOL_KINDS = {
    "Read": "code", "Write": "code", "Edit": "code", "MultiEdit": "code", "NotebookEdit": "code", "LSP": "code",
    "Glob": "file", "LS": "file", "Grep": "search", "WebSearch": "web", "WebFetch": "web", "web_search": "web",
    "Task": "task", "TodoWrite": "task", "TodoRead": "task", "Bash": "terminal", "KillShell": "terminal",
    "git": "git", "mcp": "mcp", "default": "info",
}
TOOL_WORDS = [
    ("code", ["read", "write", "edit", "lsp", "notebook", "replace"]),
    ("search", ["grep", "search"]),
    ("file", ["glob", "ls", "create"]),
    ("task", ["task", "todo", "agent"]),
    ("terminal", ["bash", "command", "shell", "kill"]),
    ("git", ["git"]),
    ("web", ["web", "fetch", "http"]),
    ("mcp", ["mcp", "server"]),
    ("document", ["document", "pdf"]),
]


def tool_kind(name: str = "tool_name") -> Column:
    """Kind of a tool: by its exact name, else by the first rule with a word at its start, after a letter or between underscores."""
    c = F.col(name)
    exact = F.create_map(*[F.lit(x) for pair in TOOL_KINDS.items() for x in pair])
    out = F.when(F.map_contains_key(exact, c), F.element_at(exact, c))
    for kind, words in TOOL_WORDS:
        any_ = "|".join(words)
        hit = c.rlike(f"(?i)(?:^|_)(?:{any_})(?:$|_)|(?:^|[a-z])(?:{any_})")
        out = out.when(hit | (F.lower(c) == "file") if kind == "file" else hit, kind)
    return out.otherwise("neutral")


def board_counters(uses: DataFrame, kind: Column) -> DataFrame:
    """Tool kinds, errors and distinct tools of each session."""
    rows = uses.withColumn("kind", kind)
    return rows.groupBy("session_id").agg(F.count("*").alias("uses"), F.count(F.when(F.col("is_error"), 1)).alias("errors"), F.countDistinct("tool_name").alias("tools"), F.countDistinct("kind").alias("kinds"))


def relevance(messages: Column, tools: Column, errors: Column, documents: Column, commits: Column) -> Column:
    """0.2 for under three messages; else 0.5 and bonuses for over five tool uses, errors, work on .md files, and commits; 1 at most."""
    bonus = lambda holds, n: F.when(holds, n).otherwise(0.0)
    score = F.lit(0.5) + bonus(tools > 5, 0.3) + bonus(errors > 0, 0.2) + bonus(documents, 0.2) + bonus(commits > 0, 0.3)
    return F.when(messages < 3, 0.2).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def depth(messages: Column, tools: Column) -> Column:
    """deep with over 15 messages or over five tool uses, else shallow."""
    return F.when((messages > 15) | (tools > 5), "deep").otherwise("shallow")


def near_commits(sessions: DataFrame, commits: DataFrame, buffer_minutes: int = 5) -> DataFrame:
    """Commits inside a session's span, widened by the buffer at both ends.

    Spans are cut into days, so that the range join is an equi-join on (project, day) with a residual
    condition; a commit lies in one day, so no pair is found twice.
    """
    lo, hi = (F.col("first_message_time") - F.expr(f"interval {buffer_minutes} minutes"), F.col("last_message_time") + F.expr(f"interval {buffer_minutes} minutes"))
    spans = sessions.select("session_id", "project_id", lo.alias("lo"), hi.alias("hi"))
    spans = spans.withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    c = commits.select("commit_id", "project_id", "committed_at", F.to_date("committed_at").alias("day"))
    return spans.join(c, ["project_id", "day"]).where("committed_at between lo and hi").select("session_id", "commit_id")


def token_ranks(usage: DataFrame) -> DataFrame:
    """usage (session_id, tokens, ...) with its place by tokens (the most first) and the number of sessions.

    Rows are dealt by ranges, each range is numbered by itself, and the sizes of the ranges before it
    (one row a range) are added: no task sees all rows.
    """
    order = [F.desc("tokens"), F.asc("session_id")]
    dealt = cut(usage.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_r", "_before")


def latest_per_file(edits: DataFrame) -> DataFrame:
    """Newest edit of each file with how many there were."""
    return edits.groupBy("file_path").agg(F.max_by("edit_id", F.struct("ts", "edit_id")).alias("edit_id"), F.max("ts").alias("ts"), F.count("*").alias("edits"))


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key; of equally frequent ones the first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counted.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, value, "n")


def scaled_share(value: Column, part: Column, whole: Column) -> Column:
    """value * part / whole in whole numbers, halves rounded up."""
    return F.floor((value * part + F.floor(whole / 2)) / whole).cast("long")


def expiring(archives: DataFrame, now: str, period: int, threshold: int) -> DataFrame:
    """Archives within `threshold` days of `period` days of age, the next to expire first."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("modified")) / 86_400_000_000)
    rows = archives.withColumn("age_days", age).where(F.col("age_days") >= max(period - threshold, 0))
    return rows.select("session_id", "age_days", F.greatest(F.lit(period) - F.col("age_days"), F.lit(0)).alias("days_remaining"))


def session_metadata(turns: DataFrame) -> DataFrame:
    """Counts and a summary: first user text, else first assistant text, else last text, at most 100 characters."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("seq")))
    out = turns.groupBy("session_id").agg(F.count("*").alias("messages"), F.count(F.when(F.col("role") == "user", 1)).alias("user_messages"), F.coalesce(first("user"), first("assistant"), F.max_by("text", "seq")).alias("s"))
    return out.select("session_id", "messages", "user_messages", F.when(F.length("s") > 100, F.concat(F.substring("s", 1, 97), F.lit("..."))).otherwise(F.col("s")).alias("summary"))
