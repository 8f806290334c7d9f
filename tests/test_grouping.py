"""Groups of projects against a plain version."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from convolake.operators import grouping

SCHEMA = "machine string, provider string, project_path string, identity_key string, git_worktree boolean, last_modified timestamp"


def plain(rows, aliases, worktrees):
    claims = defaultdict(set)
    own = lambda r: r[3] or aliases.get(r[2])
    for r in rows:
        if own(r):
            claims[r[2]].add(own(r))
    groups = defaultdict(list)
    for r in rows:
        key = own(r) or (next(iter(claims[r[2]])) if len(claims[r[2]]) == 1 else None)
        groups[key or f"path:{r[2]}"].append(r)
    out = {}
    for key, rs in groups.items():
        paths = defaultdict(list)
        for r in rs:
            paths[r[2]].append(r)
        if not worktrees:
            paths = {p: x for p, x in paths.items() if not all(r[4] for r in x)}
        if not paths:
            continue
        age = lambda p: max((r[5] for r in paths[p] if r[5]), default=datetime.min)  # noqa: E731, B023
        first = min(paths, key=lambda p: (-(age(p) - datetime.min).total_seconds(), p))  # noqa: B023
        parts = [x for x in re.split(r"[\\/]", first) if x]
        rs = [r for x in paths.values() for r in x]
        out[key] = {"name": parts[-1] if parts else first, "parents": parts[:-1], "suffix": None, "rows": len(rs), "paths": len(paths), "path": first}
    label = lambda g: f"{g['name']} — {g['suffix']}" if g["suffix"] else g["name"]
    for depth in range(1, 7):
        same = Counter(label(g) for g in out.values())
        for g in [g for g in out.values() if same[label(g)] > 1]:
            g["suffix"] = "/".join(g["parents"][-depth:]) or g["suffix"]
    return {k: (g["path"], label(g), g["paths"], g["rows"]) for k, g in out.items()}


@pytest.mark.parametrize("worktrees", [True, False])
def test_groups(spark, worktrees):
    rng = random.Random(3)
    t0 = datetime(2025, 1, 1)
    roots = ["/a/dev", "/b/dev", "/a/x/dev", "C:\\work\\dev", "/q/a/dev"]
    rows = [(rng.choice("mn"), rng.choice("pqr"), f"{rng.choice(roots)}/{rng.choice(['api', 'web', 'api/core'])}", rng.choice([None, None, "id1", "id2", "id3"]), rng.random() < 0.4, rng.choice([None, t0 + timedelta(hours=rng.randrange(50))])) for _ in range(60)]
    rows += [("m", "p", "/", None, False, t0), ("m", "p", "/only", None, None, None)]
    aliases = {"/b/dev/web": "id9", "/gone": "id1"}
    frame = spark.createDataFrame(rows, SCHEMA)
    got = grouping.groups(frame, spark.createDataFrame(list(aliases.items()), "project_path string, identity_key string"), worktrees).collect()
    want = plain(rows, aliases, worktrees)
    assert {r.key: (r.path, r.label, r.paths, r.rows) for r in got} == want
    # groups that claim one path are named alike
    assert len({r.label for r in got}) == len({r.path for r in got}) and any(r.suffix and "/" in r.suffix for r in got)
    assert grouping.groups(frame.limit(0)).count() == 0
