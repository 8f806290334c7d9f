"""Versions under a pointer, and the usage marker as state."""

import shutil

import pytest

from convolake.streaming import markers
from convolake.streaming.snapshots import Conflict, Snapshots


def ids(df):
    return sorted(r.id for r in df.collect())


def test_rebuild_swaps_whole_versions(spark, tmp_path):
    store = Snapshots(spark, f"file:{tmp_path}/t")
    with pytest.raises(ValueError):
        store.read()
    store.rebuild(lambda: spark.range(3))
    old = store.read()
    store.append(spark.range(3, 5).toDF("id"), 7)
    longer = store.read()
    assert ids(old) == [0, 1, 2] and ids(longer) == [0, 1, 2, 3, 4]

    def fails():
        raise RuntimeError("source lost")

    with pytest.raises(RuntimeError, match="source lost"):
        store.rebuild(fails)
    bad = spark.range(9).selectExpr("if(id = 8, raise_error('broken row'), id) as id")
    with pytest.raises(Exception, match="broken row"):
        store.rebuild(lambda: bad)
    assert ids(store.read()) == [0, 1, 2, 3, 4]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1

    seen = []

    def slow():
        seen.append(ids(store.read()))  # a reader while the new version is built
        return spark.range(100, 102)

    assert store.rebuild(slow).batch == 7
    assert seen == [[0, 1, 2, 3, 4]] and ids(store.read()) == [100, 101]
    assert ids(old) == [0, 1, 2] and ids(longer) == [0, 1, 2, 3, 4]  # readers keep what they opened
    assert store.append(spark.range(50), 7) == store.pointer() and ids(store.read()) == [100, 101]  # replayed
    for n in range(3):
        store.rebuild(lambda n=n: spark.range(n + 1))
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 3


def test_one_of_two_writers_wins(spark, tmp_path):
    store = Snapshots(spark, f"file:{tmp_path}/t")
    store.rebuild(lambda: spark.range(1))

    def build():
        Snapshots(spark, f"file:{tmp_path}/t").append(spark.range(1, 2).toDF("id"), 1)
        return spark.range(5)

    with pytest.raises(Conflict):
        store.rebuild(build)
    assert ids(store.read()) == [0, 1]
    assert [p for p in (tmp_path / "t/_pointer").iterdir() if not p.name.lstrip(".").startswith("0000")] == []


SCHEMA = "id long, session_id long, group_key string, text string"


def test_marker_as_state(spark, tmp_path):
    def deliver(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
        markers.mirror(stream, f"file:{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
        return {r.id: r.usage_row for r in Snapshots(spark, f"file:{tmp_path}/t").read().collect()}

    deliver(1, [(5, 1, "a", "x"), (3, 1, "a", "y"), (4, 2, "a", "z"), (6, 1, None, "n")])
    assert run() == {3: True, 4: True, 5: False, 6: True}
    # late rows with lower ids, rows that come again, a second row without group
    deliver(2, [(1, 1, "a", "late"), (3, 1, "a", "y"), (9, 3, "b", "q"), (9, 3, "b", "q"), (7, 1, None, "m")])
    want = {1: False, 3: True, 4: True, 5: False, 6: True, 7: True, 9: True}
    assert run() == want
    assert run() == want  # nothing new
    # the last batch is lost before it was committed: it runs again and gives the same
    for f in (tmp_path / "cp/commits").iterdir():
        if f.name.lstrip(".").startswith("1"):
            f.unlink()
    shutil.rmtree(next((tmp_path / "t").glob("v-*/batch=2")))
    for f in list((tmp_path / "t/_pointer").iterdir()):
        if f.name.strip(".").removesuffix(".crc").endswith("2"):
            f.unlink()
    assert run() == want
