"""Steps whose work grew faster than the input, or was done more than once a row."""

import random

from convolake.functions import extract
from convolake.operators import trees
from convolake.sources import directories
from convolake.sources.small import small_files
from convolake.streaming import markers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_files(spark, tmp_path):
    for n in range(300):
        for name in ("a.json", "b.txt", ".c.json", "_d.json"):
            (tmp_path / f"s{n % 30}" / "events").mkdir(parents=True, exist_ok=True)
            (tmp_path / f"s{n % 30}" / "events" / f"{n}{name}" if name[0] not in "._" else tmp_path / f"s{n % 30}" / "events" / f"{name[0]}{n}{name[1:]}").write_text(f"x{n}\r\ny\n")
    (tmp_path / "top.json").write_text("top")
    got = small_files(spark, f"file://{tmp_path}/*/events/*.json")
    assert sorted(r.value for r in got.collect()) == sorted(f"x{n}\r\ny\n" for n in range(300))
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    deep = small_files(spark, f"{tmp_path}/**/*.json", lines=True).collect()
    assert sorted((r.line, r.value) for r in deep) == sorted([(0, f"x{n}") for n in range(300)] + [(1, "y")] * 300 + [(0, "top")])
    assert small_files(spark, f"{tmp_path}/none/**/*.json").count() == 0


def test_stored_messages_are_read_once(spark, tmp_path):
    (tmp_path / "storage/message/s").mkdir(parents=True)
    (tmp_path / "storage/part/m").mkdir(parents=True)
    (tmp_path / "storage/message/s/m.json").write_text('{"role":"user","cost":2}')
    (tmp_path / "storage/part/m/p.json").write_text('{"type":"text","text":"hi"}')
    out = directories.storage_messages(spark, str(tmp_path))
    assert plan(out).count("MapInArrow") == 2  # messages and parts
    assert [(r.uuid, r.cost_usd, r.content) for r in out.collect()] == [("m", 2.0, '[{"type":"text","text":"hi"}]')]


def test_messages_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "[]", '{"toolUse":{"name":"Bash","id":"c"},"toolUseResult":{"is_error":true}}'), (2, 1, "assistant", '[{"type":"tool_use","id":"a","name":"Skill","input":{"skill":"k"}}]', "{}"), (3, 1, "assistant", "[]", "{}")], "id long, session_id long, type string, content string, raw string")
    uses = extract.tool_uses(rows)
    assert plan(uses).count("from_json") == 1
    got = sorted((r.id, r.seq, r.tool_name, r.tool_use_id, r.skill_name, r.is_error) for r in uses.collect())
    assert got == [(1, 0, "Bash", "c", None, True), (2, 0, "Skill", "a", "k", None)]


def test_tours_inside_tasks_and_by_joins(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for s in range(40):
        size = rng.choice([1, 5, 60, 300])
        for n in range(size):
            rows.append((None if s == 0 else s, s * 1000 + n, None if n % 50 == 0 else s * 1000 + rng.choice([rng.randrange(n), n - 1, n + 1, 10**6 if n % 7 == 0 else n - 1]), rng.randrange(20), n, rng.random() < 0.05))
    frame = spark.createDataFrame(rows, "session_id long, node long, parent long, ts long, seq long, hidden boolean")
    got = []
    for inside in (1 << 16, 50, 0):
        monkeypatch.setattr(trees, "INSIDE", inside)
        got.append(sorted(map(tuple, trees.reading_order(frame.repartition(3)).collect()), key=str))
    assert len(got[0]) > 1000 and got[0] == got[1] == got[2]


def test_state_has_few_partitions(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], "id long, session_id long, group_key string").write.parquet(f"{tmp_path}/in/part=1")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    stream = spark.readStream.schema("id long, session_id long, group_key string").parquet(f"{tmp_path}/in/part=*")
    markers.mirror(stream, f"file:{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert all(len([p for p in op.iterdir() if p.name.isdigit()]) == 32 for op in (tmp_path / "cp/state").iterdir())
