"""The stream over append-only files: growth, half lines, truncation, rewriting, removal, replay."""

import json
import os

import pytest

from convolake.sources import appended, logs


@pytest.fixture
def place(tmp_path):
    (tmp_path / "logs/a").mkdir(parents=True)
    return tmp_path


def held(spark, place):
    appended.follow(spark, f"file:{place}/logs", f"{place}/table", f"{place}/cp").awaitTermination()
    out = {}
    for r in appended.lines(spark, f"{place}/table").orderBy("file", "at").collect():
        out.setdefault(os.path.basename(r.file), []).append(r.value)
    return out


def batches(spark, place):
    rows = spark.read.schema(appended.SCHEMA + ", batch int").parquet(f"{place}/table").collect()
    return {b: sorted((os.path.basename(r.file), r["at"]) for r in rows if r.batch == b) for b in {r.batch for r in rows}}


def test_growth(spark, place):
    one, two = place / "logs/one.jsonl", place / "logs/a/two.jsonl"
    one.write_bytes(b"first\nsecond\nhalf of the th")
    two.write_bytes("é中\n".encode())
    (place / "logs/other.txt").write_bytes(b"no log\n")
    assert held(spark, place) == {"one.jsonl": ["first", "second"], "two.jsonl": ["é中"]}
    with one.open("ab") as f:
        f.write(b"ird\n\nfifth\n")
    assert held(spark, place) == {"one.jsonl": ["first", "second", "half of the third", "", "fifth"], "two.jsonl": ["é中"]}
    seen = batches(spark, place)
    assert seen[max(seen)] == [("one.jsonl", 13), ("one.jsonl", 31), ("one.jsonl", 32)]  # only what was appended
    last = max(seen)
    assert held(spark, place)["two.jsonl"] == ["é中"]
    assert max(batches(spark, place)) == last  # nothing new, no batch
    one.write_bytes(b"anew\n")  # truncated
    two.write_bytes("中é\nmore\n".encode())  # other bytes before the offset
    (place / "logs/three.jsonl").write_bytes(b"no end")
    assert held(spark, place) == {"one.jsonl": ["anew"], "two.jsonl": ["中é", "more"]}
    two.unlink()
    one.write_bytes(b"")
    assert held(spark, place) == {}
    one.write_bytes(b"again\n")
    assert held(spark, place) == {"one.jsonl": ["again"]}


def test_parts_of_a_file_give_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "SPLIT", 10)
    monkeypatch.setattr(appended, "TAIL", 7)
    path = tmp_path / "x.jsonl"
    lines = ["a", "", "b" * 9, "c" * 10, "d" * 35, "", "é" * 8, "e"]
    raw = "".join(s + "\n" for s in lines).encode()
    path.write_bytes(raw + b"unfinished")
    reader = appended.AppendedReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    assert json.loads(end["files"])[str(path)][0] == len(raw)
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) > 5
    found = [r for p in parts for r in reader.read(p)]
    assert [v for _, _, v in found] == lines
    assert all(raw[at:].startswith(v.encode() + b"\n") for _, at, v in found)
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    empty = appended.AppendedReader({"path": str(tmp_path / "missing")})
    assert empty.partitions(empty.initialOffset(), empty.latestOffset()) == []


def test_parsed_as_a_whole(spark, place):
    path = place / "logs/s.jsonl"
    said = [json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": "s", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "user", "content": f"turn {i}"}}) for i in range(6)]
    for n in (2, 5, 6):
        path.write_text("\n".join(said[:n]) + "\n" + ("{" if n == 5 else ""))
        held(spark, place)
    rows = appended.lines(spark, f"{place}/table").selectExpr("file", "0 as block", "at as line", "value")
    once = logs.canonical(spark, f"{place}/logs/*.jsonl")
    assert sorted(logs.canonical_lines(rows).collect()) == sorted(once.collect()) and once.count() == 6
