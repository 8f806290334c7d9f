"""Readers over small log files of each kind."""

import json
import sqlite3

import zstandard

from convolake.functions import extract
from convolake.sources import logs, patchlog, sqlite


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return f"file://{path}"


def test_canonical(spark, tmp_path):
    say = {"role": "assistant", "content": [{"type": "text", "text": "hi"}], "id": "msg_1", "model": "m", "usage": {"input_tokens": 100, "output_tokens": 50}}
    path = lines(tmp_path / "s.jsonl", ["{broken", {"type": "summary", "summary": "x"}, {"uuid": "u", "sessionId": "s1", "timestamp": "2025-06-26T10:01:00Z", "type": "assistant", "message": say}, {"type": "user"}])
    r = logs.canonical(spark, path).collect()
    assert len(r) == 1 and (r[0].session_id, r[0].input_tokens, r[0].output_tokens, r[0].role, r[0].seq) == ("s1", 100, 50, "assistant", 0)


def test_rollout_deltas(spark, tmp_path):
    count = lambda i, c, o: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    say = lambda role, t: {"timestamp": f"2025-01-01T00:00:0{t}Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": []}}
    rows = [{"type": "session_meta", "payload": {"id": "s"}}, {"type": "turn_context", "payload": {"model": "m"}}, say("user", 1), say("assistant", 2), count(100, 40, 10), say("user", 3), say("assistant", 4), count(180, 60, 25)]
    got = logs.rollout(spark, lines(tmp_path / "r.jsonl", rows)).orderBy("seq").collect()
    assert [(r.session_id, r.model, r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in got] == [("s", "m", None, None, None), ("s", "m", 60, 40, 10), ("s", "m", None, None, None), ("s", "m", 60, 20, 15)]


def test_records(spark, tmp_path):
    path = lines(tmp_path / "q.jsonl", [{"uuid": "a", "sessionId": "s", "timestamp": "2025-01-01T00:00:00Z", "type": "user", "message": {"parts": [1]}}, "no json", {"uuid": "b", "type": "model", "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": -1}}])
    got = logs.chat_records(spark, path, "qwen", logs.RECORDS["qwen"]).orderBy("uuid").collect()
    assert [(r.session_id, r.input_tokens, r.output_tokens) for r in got] == [("s", None, None), ("q", 7, 0)]


def test_markdown(spark, tmp_path):
    (tmp_path / "h.md").write_text("# chat started at 2024-05-01 10:00:00\n\n#### do it\n\ndone\nwell\n\n#### more\nok\n\n# chat started at 2024-05-02 10:00:00\n#### hi\n")
    got = logs.markdown(spark, f"file://{tmp_path}/h.md").orderBy("ts", "seq").collect()
    assert [(r.role, r.content) for r in got] == [("user", "do it"), ("assistant", "done\nwell"), ("user", "more"), ("assistant", "ok"), ("user", "hi"), ("assistant", "")]


def test_patch_log(spark, tmp_path):
    rows = [{"kind": 0, "v": {"requests": []}}, {"kind": 2, "k": ["requests"], "v": [{"requestId": "r", "timestamp": 1000, "message": {"text": "q"}}]}, {"kind": 1, "k": ["requests", 0, "response"], "v": [{"value": "a"}, {"value": "b"}]}, "junk", {"kind": 1, "k": ["x", "y", 2], "v": "set"}]
    states = patchlog.read(spark, lines(tmp_path / "p.jsonl", rows))
    assert json.loads(states.first().state)["x"]["y"] == [None, None, "set"]
    assert [(r.role, r.content) for r in patchlog.messages(states).orderBy("seq").collect()] == [("user", "q"), ("assistant", "ab")]


def test_events_with_causes(spark, tmp_path):
    d = tmp_path / "sess" / "events"
    d.mkdir(parents=True)
    (d / "0.json").write_text(json.dumps({"id": 0, "timestamp": "2024-01-01T00:00:00", "source": "agent", "action": "run", "message": "ls"}))
    (d / "1.json").write_text(json.dumps({"id": 1, "timestamp": "2024-01-01T00:00:01", "source": "environment", "observation": "run", "cause": 0, "content": "files"}))
    got = logs.event_directory(spark, f"file://{tmp_path}/*/events/*.json").orderBy("seq").collect()
    assert [(r.session_id, r.content) for r in got] == [("sess", "ls\nfiles"), ("sess", "files")]


def test_git_log(spark, tmp_path):
    path = lines(tmp_path / "log.txt", ["abc|Jo|1700000000|fix: a|b", "broken"])
    r = logs.git_log(spark, path).collect()
    assert len(r) == 1 and r[0].subject == "fix: a|b"


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("create table responses(id text, conversation_id text, prompt text, response text, model text, datetime_utc text, input_tokens int, output_tokens int)")
    db.execute("insert into responses values ('1', 'c', 'p', 'r', 'm', '2024-01-01T00:00:00', -5, 7), ('2', null, 'p2', 'r2', 'm', 'bad', null, null)")
    db.execute("create table kv(key text, value blob)")
    db.execute("insert into kv values ('b:1', 'x'), ('a:1', 'old'), ('a:2', 'new')")
    db.execute("create table t(id text, data blob)")
    db.executemany("insert into t values (?, ?)", [("plain", b'{"a":1}'), ("packed", zstandard.compress(b'{"b":2}'))])
    db.commit()
    db.close()
    (tmp_path / "junk.db").write_bytes(b"no database")
    path = f"file://{tmp_path}/*.db"
    got = sqlite.turns_of_responses(spark, path).orderBy("id", "role").collect()
    assert [(r.session_id, r.role, r.content, r.output_tokens) for r in got] == [("c", "assistant", "r", 7), ("c", "user", "p", None), ("(none)", "assistant", "r2", None), ("(none)", "user", "p2", None)]
    assert sqlite.key_values(spark, path, "kv", ["a:", "b:"]).first().value == "new"
    assert {r.id: r.data for r in sqlite.blobs(spark, path, "select id, data from t").collect()} == {"plain": '{"a":1}', "packed": '{"b":2}'}


def test_extraction(spark):
    use = json.dumps([{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Skill", "input": {"skill": "pdf"}}, {"type": "tool_use", "id": "t2", "name": "Agent", "input": {"subagent_type": "x"}}])
    rows = [(1, 1, "assistant", use, '{"toolUse":{"name":"No"}}'), (2, 1, "assistant", "[]", '{"toolUse":{"name":"Yes"},"messageId":"m"}'), (3, 1, "user", use, "{}"), (4, 1, "user", '[{"type":"tool_result","tool_use_id":"t1","is_error":true},{"type":"tool_result"}]', None)]
    m = spark.createDataFrame(rows, "id long, session_id long, type string, content string, raw string")
    uses = {(r.id, r.seq): (r.tool_name, r.skill_name, r.subagent_type) for r in extract.tool_uses(m).collect()}
    assert uses == {(1, 0): ("Skill", "pdf", None), (1, 1): ("Agent", None, "x"), (2, 0): ("Yes", None, None)}
    assert [(r.id, r.tool_use_id, r.is_error) for r in extract.tool_results(m).collect()] == [(4, "t1", True)]
    text = {r.id: r.search_text for r in extract.search_text(m, "content").collect()}
    assert text[1] == "hi Skill pdf Agent x" and text[2] == ""


def test_documents(spark, tmp_path):
    (tmp_path / "c1.json").write_text(json.dumps({"history": [{"message": {"role": "user", "content": "hi"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}}]}))
    (tmp_path / "c2.json").write_text("broken")
    docs = logs.json_files(spark, f"file://{tmp_path}/*.json")
    got = logs.document_turns(docs, "continue", *logs.DOCUMENTS["continue"]).orderBy("seq").collect()
    assert [(r.session_id, r.seq, r.role, r.provider) for r in got] == [("c1", 0, "user", "continue"), ("c1", 1, "assistant", "continue")]
    one = spark.createDataFrame([("o", json.dumps({"messages": [{"id": "a", "role": "assistant", "time": {"created": 1700000000000}, "tokens": {"input": 5, "output": -1}}]}))], "session_id string, data string")
    r = logs.document_turns(one, "opencode", *logs.DOCUMENTS["opencode"]).first()
    assert (r.input_tokens, r.output_tokens, str(r.ts)) == (5, 0, "2023-11-14 22:13:20")
    assert logs.union_of(logs.document_turns(docs, "a", *logs.DOCUMENTS["pearai"]), logs.document_turns(one, "b", *logs.DOCUMENTS["opencode"])).count() == 3


def test_usage_records(spark, tmp_path):
    path = lines(tmp_path / "usage.jsonl", [{"recordType": "usage", "sessionId": "s", "inputTokens": 3}, {"recordType": "other"}])
    assert [(r.session_id, r.input_tokens, r.output_tokens) for r in logs.usage_records(spark, path).collect()] == [("s", 3, 0)]
