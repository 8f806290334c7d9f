"""Edits in raw messages: create, single, several and patch."""

import json

from pyspark.sql import functions as F

from convolake.operators import edits


def found(spark, messages, cwd=None):
    rows = [(i, json.dumps(m) if not isinstance(m, str) else m, cwd) for i, m in enumerate(messages)]
    frame = spark.createDataFrame(rows, "ts long, raw string, cwd string")
    out = edits.edits(frame, cwd="cwd" if cwd else None).orderBy("ts", "place").collect()
    return [(r.ts, r.op, r.file_path, r.content, r.original, r.lines_added, r.lines_removed) for r in out]


def test_results(spark):
    r = lambda **x: {"toolUseResult": x}
    many = [{"old_string": "one", "new_string": "1\nuno"}, {"old_string": "two", "new_string": ""}, {"old_string": "missing", "new_string": "x"}, {"old_string": 5, "new_string": "y"}, {"old_string": "uno", "new_string": "$1\\"}]
    got = found(spark, [
        r(type="create", filePath="/a", content="l1\nl2\n"),
        r(filePath="/b", oldString="two", newString="zwei\ndrei", originalFile="one two two"),
        r(filePath="/c", edits=many, originalFile="one one two"),
        r(filePath="/d", edits="no list", originalFile="text"),
        r(filePath="/e", oldString="", newString="top\n", originalFile="é中"),
        {"toolUse": {"name": "Write", "input": {"file_path": "/f", "content": ""}}},
        r(filePath="/g", oldString="x", newString="y"),
        r(filePath=7, type="create", content="x"),
        {"toolUseResult": "plain text"}, "no json", {"toolUse": {"name": "write", "input": {"file_path": "/h", "content": "x"}}},
        r(type="create", filePath="/i", content="same", originalFile="was", oldString="w", newString="W"),
    ])
    assert got == [
        (0, "write", "/a", "l1\nl2\n", None, 2, 0),
        (1, "edit", "/b", "one zwei\ndrei two", "one two two", 2, 1),
        (2, "edit", "/c", "1\n$1\\ one ", "one one two", 4, 4),
        (3, "edit", "/d", "text", "text", 0, 0),
        (4, "edit", "/e", "top\né中", "é中", 1, 0),
        (5, "write", "/f", "", None, 0, 0),
        (11, "write", "/i", "same", None, 1, 0),
        (11, "edit", "/i", "Was", "was", 1, 1),
    ]


PATCH = "*** Begin Patch\n*** Update File: src/a.rs\n@@\n-old\n+new\n+more\n*** Add File: b.txt\n+++ b/b.txt\n--- /dev/null\n+x\n*** Delete File: /abs/c\n"


def test_tool_uses(spark):
    use = lambda name, **x: {"type": "tool_use", "name": name, "input": x}
    got = found(spark, [
        {"content": [{"type": "text"}, use("MultiEdit", path="", filePath="x.py", new_string="a\nb", old_string="c"), use("apply_patch", patch=PATCH)]},
        {"toolUse": {"name": "write_to_file", "input": {"TargetFile": "/t", "k": 1}}},
        {"content": [use("Read", file_path="x"), use("apply_patch"), use("edit", content="no path"), {"type": "tool_use", "name": "edit"}]},
        {"content": "text", "toolUse": {"name": "Edit"}},
    ], "/work/")
    assert got[0] == (0, "edit", "/work/x.py", "a\nb", None, 2, 1)
    assert [g[:3] + g[5:] for g in got[1:4]] == [(0, "edit", "/work/src/a.rs", 3, 1), (0, "edit", "/work/b.txt", 3, 1), (0, "edit", "/abs/c", 3, 1)]
    assert got[4][:3] == (1, "write", "/t") and json.loads(got[4][3]) == {"TargetFile": "/t", "k": 1}
    assert len(got) == 5


def test_recent(spark):
    rows = [(t, "" if t else None, f"/p/{f}", 0) for t, f in enumerate("abacab")] + [(9, "", "/q/z", 0), (9, "", "/q/z", 1)]
    frame = spark.createDataFrame(rows, "ts long, content string, file_path string, place int")
    got = edits.recent(frame, cwd="/p", limit=2).collect()
    assert [(r.file_path, r.ts, r.edits, r.total_edits, r.unique_files) for r in got] == [("/p/b", 5, 2, 6, 3), ("/p/a", 4, 3, 6, 3)]
    assert [r.file_path for r in edits.recent(frame, cwd="/p", offset=2).collect()] == ["/p/c"]
    assert edits.recent(frame).first().place == 0
    assert edits.recent(frame.where(F.lit(False))).count() == 0
