"""Names of projects and messages, filters, and what ingest does with them."""

import hashlib
import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from convolake.functions import identity
from convolake.operators import filters, ingest

ROOT = "A3f0c1d2e3f4a5b6c7d8e9f0a1b2c3d4e5f6a7b8"


def plain_remote(raw):
    s = raw.strip()
    if "://" in s:
        scheme, rest = s.split("://", 1)
        if scheme.lower() not in ("http", "https", "ssh", "git"):
            return None
        host, _, path = rest.partition("/")
    else:
        c, d = s.find(":"), s.find("/")
        if c >= 0 and (d < 0 or c < d):
            host, path = s[:c], s[c + 1 :]
            port = path.split("/")[0]
            if "@" not in host and port.isdigit():
                if "/" not in path:
                    return None
                host, path = f"{host}:{port}", path.split("/", 1)[1]
        elif d >= 0:
            host, path = s[:d], s[d + 1 :]
        else:
            return None
    host = host.rsplit("@", 1)[-1].lower()
    name = host.split(":")[0]
    if "." not in name or "" in name.split("."):
        return None
    path = path.strip("/").removesuffix(".git").rstrip("/")
    return f"{host}/{path}" if path else None


def test_remote_urls(spark):
    rng = random.Random(1)
    hosts = ["github.com", "Git.Example.org:8443", "gitea", "..", "a..b", "user@Host.io", "user:pw@h.io:22", "", "host.io:", "1.2.3.4"]
    paths = ["/o/r.git", "o/r", "/o/r.git/", "", "/", "22/o/r", "22", "//o//r//", ".git", "/o/r.git.git", "o r", "a@b/c"]
    urls = [f"{s}{h}{j}{p}" for s, h, j, p in itertools.product(["", "https://", "SSH://", "git://", "file://", "ftp://", "://"], hosts, ["", ":", "/"], paths)]
    urls += [" git@github.com:o/r.git \n", "/srv/repo", "../repo", "C:\\repo", "x", ""] + ["".join(rng.choice("a.:/@g") for _ in range(12)) for _ in range(400)]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", identity.remote_url(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in rows} == {u: plain_remote(u) for u in urls}
    kept = [r.r for r in rows if r.r]
    again = spark.createDataFrame([(u,) for u in kept], "u string").select("u", identity.remote_url(F.col("u")).alias("r")).collect()
    assert len(set(kept)) > 20
    assert all(r.r == plain_remote(r.u) for r in again)


def test_keys(spark):
    rows = spark.createDataFrame([(ROOT, "git@github.com:o/r.git"), (f" {ROOT} ", "/local"), ("abc", "https://h.io/x"), (None, None)], "root string, remote string")
    got = [r[0] for r in rows.select(identity.identity_key(F.col("root"), F.col("remote"))).collect()]
    assert got == [f"g:{ROOT.lower()}|github.com/o/r", f"g:{ROOT.lower()}", "r:h.io/x", None]
    blobs = spark.createDataFrame([("a" * 40,), ("A" * 40,), ("a" * 39,), ("a" * 40 + "\n",), ("",)], "b string")
    assert [r[0] for r in blobs.select(identity.is_blob_id(F.col("b"))).collect()] == [True, False, False, False, False]
    cases = [("p", "s", "2025", "user", 7, '{"é":1}', None, None), ("p", "s", None, "user", -2, None, '{"a":2}', "[]"), ("", "", "", "", 70000, None, None, None)]
    frame = spark.createDataFrame(cases, "p string, s string, t string, k string, n int, c string, u string, r string")
    for case, row in zip(cases, frame.select(identity.message_key(*(F.col(c) for c in frame.columns))).collect()):
        raw = b"".join((x or "").encode() + b"\0" for x in case[:4]) + struct.pack("<i", case[4])
        raw += b"".join(x.encode() + bytes([i + 1]) for i, x in enumerate(case[5:]) if x is not None)
        assert row[0] == hashlib.sha256(raw).hexdigest()


def test_filters(spark):
    rows = spark.createDataFrame([("user", None, None, None), ("progress", None, None, None), ("system", None, None, None), ("system", "turn_duration", None, None), ("system", "api_error", True, None), (None, None, None, None), ("summary", None, None, None), ("assistant", "turn_duration", False, True)], "k string, sub string, meta boolean, side boolean")
    got = rows.select(filters.visible(F.col("k"), F.col("sub")), filters.counted(F.col("k"), F.col("meta"), F.col("side")), filters.counted(F.col("k"), F.col("meta"), F.col("side"), True)).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, True, True), (False, True, True), (True, False, False), (True, False, False), (True, False, False), (True, False, True)]
    cards = spark.createDataFrame([("mode-x", "code", ["/a/b.MD"], ["ls"], ["s1"], False, True, False, True, False, False), (None, "git", [], None, [], True, False, True, False, True, None)], "model string, variant string, edited_files array<string>, shell_commands array<string>, mcp_servers array<string>, is_file_edit boolean, is_git boolean, is_error boolean, is_cancelled boolean, is_commit boolean, has_hook boolean")
    card = {c: F.col(c) for c in cards.columns}
    want = {("model", "de-x"): (True, False), ("tool", "document"): (True, False), ("tool", "code"): (True, True), ("tool", "git"): (True, True), ("tool", "search"): (False, False), ("status", "error"): (False, True), ("status", "cancelled"): (True, False), ("status", "commit"): (False, True), ("status", "x"): (False, False), ("file", "b.MD"): (True, False), ("hook", ""): (False, False), ("command", "ls"): (True, False), ("mcp", "all"): (True, False), ("mcp", "s1"): (True, False), ("x", "y"): (False, False)}
    got = cards.select(*[filters.brush(k, v, card).alias(f"{k}-{v}") for k, v in want]).collect()
    assert {kv: (got[0][f"{kv[0]}-{kv[1]}"], got[1][f"{kv[0]}-{kv[1]}"]) for kv in want} == want
    m = spark.createDataFrame([("user", True, False, False, False), ("assistant", False, True, True, False), ("system", True, False, False, True), (None, False, False, False, False)], "r string, t boolean, th boolean, tl boolean, cmd boolean")
    pick = lambda roles, kinds: [r[0] for r in m.select(filters.chosen(*(F.col(c) for c in m.columns), roles, kinds)).collect()]
    assert pick({}, {}) == [True, True, True, False]
    assert pick({"user": False}, {"thinking": False, "commands": False}) == [False, True, False, False]
    assert pick({}, {"thinking": False, "tool_calls": False, "text": False}) == [False, False, True, False]
    paths = spark.createDataFrame([("/p/subagents/a.jsonl",), ("C:\\p\\subagents\\a",), ("/p/subagents.jsonl",), (None,)], "f string")
    assert [r[0] for r in paths.select(filters.is_sub_agent(F.col("f"))).collect()] == [True, True, False, False]


def test_ingest(spark):
    kind = "machine_id long, hostname string, os string, first_seen timestamp, last_seen timestamp"
    t = lambda s: spark.sql(f"select timestamp '{s}'").first()[0]
    old = spark.createDataFrame([(1, "a", "x", t("2025-01-01 00:00:00"), t("2025-01-01 00:09:30")), (2, "b", "x", t("2025-01-01 00:00:00"), t("2025-01-01 00:09:30")), (3, "c", "x", t("2025-01-01 00:00:00"), t("2025-01-01 00:00:00")), (4, "d", "x", t("2025-01-01 00:00:00"), t("2025-01-01 00:00:00"))], kind)
    batch = spark.createDataFrame([(1, "a", "x"), (2, "new", "x"), (3, "c", "x"), (9, "z", None)], "machine_id long, hostname string, os string")
    got = {r.machine_id: (r.hostname, r.written, str(r.last_seen)[11:]) for r in ingest.heartbeat(old, batch, "2025-01-01 00:10:00").collect()}
    assert got == {1: ("a", False, "00:09:30"), 2: ("new", True, "00:10:00"), 3: ("c", True, "00:10:00"), 4: ("d", False, "00:00:00"), 9: ("z", True, "00:10:00")}
    columns = "machine_id long, provider string, project_path string, name string, git_root_commit string, git_remote_url string, git_worktree boolean, git_main_path string, identity_key string"
    stored = spark.createDataFrame([(1, "p", "/a", "old", ROOT.lower(), None, True, None, "stale"), (1, "p", "/b", "b", None, None, False, None, None)], columns)
    come = spark.createDataFrame([(1, "p", "/a", "new", "not a hash", "git@h.io:o/r.git", None, None), (1, "p", "/c", "c", None, "file:///x", None, None)], columns.rsplit(", ", 1)[0])
    got = {r.project_path: (r.name, r.git_root_commit, r.git_remote_url, r.git_worktree, r.identity_key) for r in ingest.upsert_projects(stored, come).collect()}
    assert got == {"/a": ("new", ROOT.lower(), "h.io/o/r", True, f"g:{ROOT.lower()}|h.io/o/r"), "/b": ("b", None, None, False, None), "/c": ("c", None, None, None, None)}
    aliases = spark.createDataFrame([("/x", "k1")], "project_path string, identity_key string")
    carried = spark.createDataFrame([("k1",), ("k2",)], "identity_key string")
    got = ingest.set_aliases(aliases, spark.createDataFrame([("/x", "k2"), ("/y", "k1")], "project_path string, identity_key string"), carried)
    assert sorted(tuple(r) for r in got.collect()) == [("/x", "k2"), ("/y", "k1")]
    with pytest.raises(ValueError, match="k9"):
        ingest.set_aliases(aliases, spark.createDataFrame([("/x", "k9")], "project_path string, identity_key string"), carried)
