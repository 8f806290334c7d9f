"""Sessions over several files, and transcripts with the calls that spawned them."""

import json

import pytest

from convolake.sources import directories


def put(path, *records, lines=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records) if lines else json.dumps(records[0]))


@pytest.fixture
def sessions(tmp_path):
    a, b, c = (tmp_path / f"sessions/p/{s}" for s in ("s-1", "s-2", "s-3"))
    put(a / "context.jsonl", {"role": "_system_prompt", "content": "You are."}, {"role": "_checkpoint", "id": "cp"}, {"role": "user", "content": "Add it"}, {"role": "_usage"}, {"role": "other", "content": "?"},
        {"role": "assistant", "content": [{"type": "think", "think": "I should look."}, {"type": "text", "text": "I look."}], "tool_calls": [{"id": "t\"1", "function": {"name": "Shell", "arguments": "{\"command\":\"rg x\"}"}}, {"name": "N", "arguments": "no json"}]},
        {"role": "tool", "tool_call_id": "t\"1", "content": "mod.rs"}, {"role": "assistant", "id": "own", "content": 5})
    put(a / "wire.jsonl", {"type": "hello"}, {"timestamp": 1770000000.0}, {"timestamp": -5}, {"timestamp": 1770000010.25})
    put(a / "state.json", {"custom_title": " Title "}, lines=False)
    put(b / "context.jsonl", {"role": "user", "content": [{"type": "text", "text": "Second"}, {"type": "x"}]}, {"role": "assistant"})
    put(b / "state.json", {"custom_title": ""}, lines=False)
    put(c / "context.jsonl", {"role": "_system_prompt"})
    return f"{tmp_path}/sessions"


def test_context_messages(spark, sessions):
    rows = directories.context_messages(spark, sessions).orderBy("session_id", "seq").collect()
    one = [r for r in rows if r.session_id == "s-1"]
    assert [(r.seq, r.role, r.uuid) for r in one] == [(0, "user", "s-1-1"), (1, "assistant", "s-1-3"), (2, "tool", "s-1-4"), (3, "assistant", "own")]
    assert {r.ts.timestamp() for r in one} == {1770000000.0}
    assert json.loads(one[0].content) == [{"type": "text", "text": "Add it"}]
    assert json.loads(one[1].content) == [{"type": "thinking", "thinking": "I should look."}, {"type": "text", "text": "I look."}, {"type": "tool_use", "id": "t\"1", "name": "Shell", "input": {"command": "rg x"}}, {"type": "tool_use", "id": "", "name": "N", "input": {"input": "no json"}}]
    assert json.loads(one[2].content) == [{"type": "tool_result", "tool_use_id": "t\"1", "content": "mod.rs"}]
    assert json.loads(one[3].content) == [{"type": "text", "text": "5"}]
    two = [r for r in rows if r.session_id == "s-2"]
    assert len(rows) == 6 and two[0].ts is not None and json.loads(two[1].content) == []


def test_context_sessions(spark, sessions):
    got = {r.session_id: r for r in directories.context_sessions(spark, sessions).collect()}
    assert set(got) == {"s-1", "s-2"}
    one, two = got["s-1"], got["s-2"]
    assert (one.message_count, one.has_tool_use, one.summary) == (4, True, "Title")
    assert (one.first_message_time.timestamp(), one.last_modified.timestamp()) == (1770000000.0, 1770000010.25)
    assert (two.message_count, two.has_tool_use, two.summary, two.first_message_time) == (2, False, "Second", None) and two.last_modified


def test_storage_messages(spark, tmp_path):
    m, p = tmp_path / "storage/message/ses", tmp_path / "storage/part"
    put(m / "m1.json", {"role": "user", "time": {"created": 1000}}, lines=False)
    put(m / "m2.json", {"role": "assistant", "parentID": "m1", "modelID": "big", "time": {"created": 2000}}, lines=False)
    put(m / "m3.json", {"role": "assistant", "time": {"created": 3000}, "tokens": {"input": 7}, "cost": 0.5}, lines=False)
    put(p / "m1/p1.json", {"type": "text", "text": "hi"}, lines=False)
    for i, (n, cost) in enumerate([(3, 0.25), (4, 0), (None, 0.5)]):
        put(p / f"m2/p{i}.json", {"type": "step-finish", "cost": cost, "tokens": {"input": n, "output": 1, "cache": {"read": 2}} if n else {"output": 2}}, lines=False)
    put(p / "m2/p9.json", {"type": "text", "text": "done", "tokens": {"input": 99}}, lines=False)
    put(p / "m3/p0.json", {"type": "step-finish", "cost": 9, "tokens": {"input": 100}}, lines=False)
    rows = directories.storage_messages(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.uuid, r.seq, r.role, r.parent_uuid, r.model, r.input_tokens, r.output_tokens, r.cache_creation_tokens, r.cache_read_tokens, r.cost_usd) for r in rows] == [
        ("m1", 0, "user", None, None, None, None, None, None, None),
        ("m2", 1, "assistant", "m1", "big", 7, 4, None, 4, 0.75),
        ("m3", 2, "assistant", None, None, 7, None, None, None, 0.5),
    ]
    assert [x["type"] for x in json.loads(rows[1].content)] == ["step-finish"] * 3 + ["text"]


def test_transcripts(spark, tmp_path):
    d = tmp_path / "subagents"
    said = lambda t, role="user", content="Do it": {"type": role, "timestamp": t, "message": {"role": role, "content": content}}
    put(d / "agent-b.jsonl", said("2025-01-02T00:00:00Z", content=[{"type": "x"}, {"text": "w" * 150}]), {"type": "assistant"}, said("2025-01-02T00:01:00Z", "assistant"))
    put(d / "agent-b.meta.json", {"toolUseId": "toolu_9"}, lines=False)
    put(d / "agent-a.jsonl", said("2025-01-01T00:00:00Z", "assistant"))
    put(d / "agent-a.meta.json", {"toolUseId": ""}, lines=False)
    put(d / "agent-c.jsonl", {"type": "user", "message": {"role": "user", "content": "no time"}})
    put(d / "main.jsonl", said("2024-01-01T00:00:00Z"))
    got = [(r.agent_id, r.message_count, r.first_message_time, r.last_message_time, r.summary, r.tool_use_id) for r in directories.transcripts(spark, str(d)).collect()]
    assert got == [
        ("c", 1, None, None, "no time", None),
        ("a", 1, "2025-01-01T00:00:00Z", "2025-01-01T00:00:00Z", None, None),
        ("b", 3, "2025-01-02T00:00:00Z", "2025-01-02T00:01:00Z", "w" * 100, "toolu_9"),
    ]
