"""Rules by examples."""

import json

from pyspark.sql import functions as F

from convolake.functions import extract
from convolake.functions import text as T
from convolake.operators import board
from convolake.streaming import refresh


def test_usage_objects_count_whole(spark):
    u = lambda **k: {("cache_read_input_tokens" if n == "cache" else f"{n}_tokens"): v for n, v in k.items()}
    rows = [
        ({"message": {"usage": u(input=5)}, "content": {"usage": u(output=9)}, "toolUseResult": {"totalTokens": 70}}, (5, None, None)),
        ({"usage": u(output=2), "toolUseResult": {"usage": u(input=3)}}, (None, 2, None)),
        ({"content": {"usage": u(input=1, output=2)}, "toolUseResult": {"usage": u(output=8, cache=4)}}, (1, 8, 4)),
        ({"type": "assistant", "toolUseResult": {"totalTokens": 70}}, (None, 70, None)),
        ({"type": "user", "toolUseResult": {"totalTokens": 70}}, (70, None, None)),
        ({"type": "assistant", "content": {"usage": u(cache=1)}, "toolUseResult": {"totalTokens": 7}}, (None, 7, 1)),
        ({"type": "assistant", "content": {"usage": u(input=1)}, "toolUseResult": {"totalTokens": 7}}, (1, None, None)),
        ({"toolUseResult": {"totalTokens": -7}}, (None, None, None)),
    ]
    frame = spark.createDataFrame([(n, json.dumps(r)) for n, (r, _) in enumerate(rows)], "n int, raw string")
    got = frame.select("n", *[c.alias(k) for k, c in extract.usage(F.col("raw")).items()]).orderBy("n").collect()
    assert [(r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in got] == [w for _, w in rows]


def test_tool_kinds(spark):
    want = {"Read": "code", "default": "info", "mcp": "mcp", "Grep": "search", "web_search": "web", "notebook_run": "code", "SemanticSearch": "search", "file": "file", "profile": "neutral", "sub_agent": "task", "PowerShell": "terminal", "GitStatus": "git", "my_server": "mcp", "PdfView": "document", "": "neutral", None: "neutral"}
    got = spark.createDataFrame([(n,) for n in want], "tool_name string").select("tool_name", board.tool_kind().alias("k")).collect()
    assert {r.tool_name: r.k for r in got} == want


def test_relevance_and_depth(spark):
    rows = [(2, 9, 9, True, 9), (3, 0, 0, False, 0), (20, 6, 0, False, 0), (3, 5, 1, False, 0), (3, 0, 0, True, 0), (3, 0, 0, False, 1), (3, 6, 1, True, 1)]
    c = F.col
    got = spark.createDataFrame(rows, "m int, t int, e int, d boolean, c int").select(board.relevance(c("m"), c("t"), c("e"), c("d"), c("c")).alias("r"), board.depth(c("m"), c("t")).alias("depth")).collect()
    assert [r.r for r in got] == [0.2, 0.5, 0.8, 0.7, 0.7, 0.8, 1.0]
    assert [r.depth for r in got] == ["deep", "shallow", "deep", "shallow", "shallow", "shallow", "deep"]


def test_stats_modes(spark):
    rows = [("user", "claude", False, False), ("assistant", "claude", True, True), ("system", "claude", None, False), ("summary", "claude", False, True), ("progress", "claude", False, False), ("progress", "claude", False, True), ("new kind", "claude", False, None), ("user", "antigravity", False, False), ("user", "antigravity", False, True), ("user", None, None, None)]
    frame = spark.createDataFrame(rows, "kind string, provider string, is_sidechain boolean, has_usage boolean")
    got = frame.select(board.stats_mode("conversation_only").alias("c"), board.stats_mode("billing_total").alias("b"), board.stats_mode(None).alias("n")).collect()
    assert [r.c for r in got] == [True, False, False, False, False, False, False, False, True, True]
    assert [r.b for r in got] == [True, True, True, False, False, True, False, False, True, True]
    assert [r.n for r in got] == [r.b for r in got]


def test_failures_wait_from_the_third_on(spark):
    rows = [("a", "failed", 1), ("b", "failed", 1), ("b", "failed", 2), ("b", "failed", 3), *[("c", "failed", n) for n in range(4)], *[("d", "failed", n) for n in range(30)], ("e", "failed", 1), ("e", "ok", 2), ("e", "failed", 3)]
    frame = spark.createDataFrame(rows, "key string, outcome string, n int").withColumn("at", F.timestamp_seconds("n"))
    assert {r.key: r.wait_minutes for r in refresh.retry_after(frame).collect()} == {"a": 0, "b": 15, "c": 30, "d": 1440, "e": 0}


def test_entry_points_and_nul(spark):
    frame = spark.createDataFrame([("cli",), ("copilot-vscode",), ("CLI",), (None,)], "raw string")
    assert [(r[0], r[1], r[2]) for r in frame.select(T.entrypoint_kind(F.col("raw")), T.entrypoint_matches(F.col("raw"), "all"), T.entrypoint_matches(F.col("raw"), "cli")).collect()] == [("cli", True, True), ("vscode", True, False), (None, True, False), (None, True, False)]
    said = spark.createDataFrame([('{"k\\u0000": ["\\\\u0000", "\\\\\\u0000"]} \0',)], "j string").select(T.replace_nul(F.col("j")).alias("j")).first().j
    assert said == '{"k�": ["\\\\u0000", "\\\\�"]} �'


def test_ranks_by_ranges(spark):
    rows = [(i, (i * 37) % 50) for i in range(200)]
    got = {r.session_id: (r.place, r.total) for r in board.token_ranks(spark.createDataFrame(rows, "session_id long, tokens long")).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {i: (n, 200) for n, (i, _) in enumerate(order, 1)}
