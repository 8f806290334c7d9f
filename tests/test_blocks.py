"""Text, ids and flags by block types."""

import json

from pyspark.sql import functions as F

from convolake.functions import blocks as B


def test_blocks(spark):
    use = {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"error": 1}}
    messages = {
        "plain": ({"type": "user", "content": "hello"}, "hello", "", (False, False, False)),
        "mixed": ({"type": "assistant", "content": ["s", {"type": "text", "text": "a" * 12_000}, {"type": "thinking", "thinking": "th"}, use, {"type": "image", "text": "no"}]}, "s " + "a" * 10_000 + " th Edit", "t1", (True, False, True)),
        "result": ({"type": "user", "content": [{"type": "tool_result", "tool_use_id": "t2", "content": "An \"Error\\\" came"}], "toolUseResult": {"stdout": "o" * 6000, "stderr": "e", "content": [1]}}, "An \"Error\\\" came " + "o" * 5000 + " e", "t2", (True, True, False)),
        "text result": ({"type": "assistant", "toolUseResult": "r" * 6000, "toolUse": {"name": "Bash", "id": "t3"}}, "Bash " + "r" * 5000, "t3", (True, False, False)),
        "not a speaker": ({"type": "system", "level": "error", "toolUseResult": "r", "toolUse": {"name": "x", "id": "y"}, "content": None}, "", "", (True, True, False)),
        "web": ({"content": [{"type": "web_search_tool_result", "content": [{"title": "T", "url": "U"}, 5, {"url": "V"}]}, {"type": "web_search_tool_result", "content": {"title": "One"}}, {"type": "web_fetch_tool_result", "content": {"url": "W", "content": {"title": "D"}}}]}, "T U V One W D", "", (False, False, False)),
        "more": ({"content": [{"type": "document", "title": "t", "context": "c", "source": {"type": "text", "data": "d"}}, {"type": "search_result", "source": "s", "content": [{"text": "x"}]}, {"type": "mcp_tool_use", "server_name": "m", "tool_name": "n"}, {"type": "mcp_tool_result", "content": {"text": "p", "uri": "q"}}, {"type": "mcp_tool_result", "content": "z"}, {"type": "tool_search_tool_result", "content": [{"tool_name": "k", "description": "l"}]}, {"type": "code_execution_tool_result", "content": {"stdout": "o", "stderr": "e"}}]}, "t c d s x m n p q z k l o e", "", (False, False, False)),
        "keys don't count": ({"content": [{"is_error": True, "errors": {"error": ["x", ":fine", "\\"]}}]}, "", "", (False, False, False)),
        "deep": ({"content": {"a": [{"b": ["x\\", "some ERRORS \n"]}]}}, "", "", (False, True, False)),
        "reason": ({"stopReasonSystem": "API Error"}, "", "", (False, True, False)),
        "empty": ({}, "", "", (False, False, False)),
    }
    rows = spark.createDataFrame([(k, json.dumps(m)) for k, (m, *_) in messages.items()], "k string, raw string").withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    got = rows.select("k", B.searchable_text(v).alias("t"), B.tool_ids(v).alias("i"), B.has_tool_calls(v).alias("c"), B.has_errors(v).alias("e"), B.has_file_changes(v).alias("f"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (r.t, r.i, (r.c, r.e, r.f)) for r in got.collect()} == {k: (t, i, f) for k, (_, t, i, f) in messages.items()}


def test_long_texts_don_t_recurse(spark):
    raw = json.dumps({"content": [{"text": "line\n\"q\"\\ " * 200_000}, {"text": "x" * 3_000_000 + " error"}]})
    row = spark.createDataFrame([(raw,)], "raw string").select(F.try_parse_json("raw").alias("v")).select(B.has_errors(F.col("v")).alias("e"), F.length(B.searchable_text(F.col("v"))).alias("n")).first()
    assert (row.e, row.n) == (True, 20_001)
