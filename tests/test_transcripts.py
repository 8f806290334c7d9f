"""Transcripts against a plain version, and what content says."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convolake.operators import transcripts
from convolake.sources import logs


def plain(rows, budget):
    text = "\n".join(f"{role or '?'}: {t}" for _, role, t, side in sorted(rows, key=lambda r: r[0]) if not side and t and t.strip())
    if len(text) <= budget:
        return text
    head = int(budget * 0.6)
    return text[:head] + transcripts.CUT + text[-(budget - head) :]


@pytest.mark.parametrize("budget", [40, 200, 5000])
def test_transcripts(spark, budget):
    rng = random.Random(2)
    sessions = {s: [(i, rng.choice(["user", "assistant", None, ""]), rng.choice(["", " ", None, "word é中 " * rng.randrange(1, 9), "x" * rng.randrange(1, 120)]), rng.random() < 0.1) for i in range(rng.randrange(1, 40))] for s in range(40)}
    frame = spark.createDataFrame([(s, *r) for s, rs in sessions.items() for r in rs], "session_id long, seq long, role string, text string, is_sidechain boolean")
    got = {r.session_id: r.transcript for r in transcripts.transcripts(frame, budget).collect()}
    assert got == {s: t for s, rs in sessions.items() if (t := plain(rs, budget))}


def test_content_text(spark):
    cases = {
        "null": (None, ""),
        "text": ("plain", "plain"),
        "blocks": ([{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "t" * 600}, {"type": "tool_use", "input": {"k": 1}}, {"type": "tool_use", "name": "N", "input": {"k": "v" * 400}}, {"type": "tool_result", "content": ["x"]}, {"type": "image"}, "stray", {"type": "text"}], "\n".join(["a", "[thinking] " + "t" * 500, '[tool_use ?] {"k":1}', '[tool_use N] {"k":"' + "v" * 294, '[tool_result] ["x"]'])),
        "object": ({"a": "b" * 600}, '{"a":"' + "b" * 494),
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()], "k string, raw string").withColumn("v", F.parse_json("raw"))
    got = {r.k: r.t for r in rows.select("k", transcripts.content_text(F.col("v")).alias("t")).collect()}
    assert got == {k: t for k, (_, t) in cases.items()}


def test_chosen_providers(spark):
    def broken():
        raise AssertionError("this store is not to be touched")

    readers = {"a": lambda: spark.createDataFrame([(1,)], "id long"), "b": broken, "c": lambda: spark.createDataFrame([(2,)], "id long")}
    assert sorted(r.id for r in logs.chosen(readers, exclude=["b"]).collect()) == [1, 2]
    assert [r.id for r in logs.chosen(readers, only=["c"]).collect()] == [2]
    with pytest.raises(ValueError):
        logs.chosen(readers, only=["x"])
    with pytest.raises(ValueError):
        logs.chosen(readers, only=["a"], exclude=["a"])


def test_times_of_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"role": "user", "message": {"content": "hi"}}) + "\n")
    row = logs.chat_records(spark, f"{tmp_path}/*.jsonl", "cursor_agent", logs.RECORDS["cursor_agent"], times_of_files=True).first()
    assert abs(row.ts.timestamp() - (tmp_path / "s.jsonl").stat().st_mtime) < 2 and row.content == "hi"
