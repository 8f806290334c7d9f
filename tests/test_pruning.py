"""What reaches the scan, and what databases of other shapes give."""

import sqlite3
from datetime import datetime

import pytest

from convolake.operators import scope
from convolake.sources import sqlite


def test_windows_reach_the_scan(spark, tmp_path):
    rows = [(i, 1, 1, datetime(2024, 3, 30, 20), "g") for i in range(3)] + [(9, 1, 1, None, "g")]
    columns = "id long, session_id long, project_id long, ts timestamp, group_key string"
    tokens = [f"1 AS {c}" for c in scope.TOKENS]
    spark.createDataFrame(rows, columns).selectExpr("id", "session_id", "ts", "group_key", *tokens).write.parquet(f"{tmp_path}/m")
    messages = spark.read.parquet(f"{tmp_path}/m")
    sessions = spark.createDataFrame([(1, 1)], "session_id long, project_id long")
    projects = spark.createDataFrame([(1, "p")], "project_id long, project_path string")
    window = scope.StatsWindow("2024-03-30", "2024-03-31", "Europe/Rome")
    got = scope.stats_scope(messages, sessions, projects, window)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert got.count() == 3
    assert scope.stats_scope(messages, sessions, projects).count() == 4


@pytest.mark.parametrize("zone", ["Europe/Rome", "America/Havana", "America/Sao_Paulo", "Asia/Beirut", "Pacific/Apia", "Asia/Kathmandu", "UTC"])
def test_local_dates_decide(spark, zone):
    """Every half hour around days on which clocks change, against the dates that the zone shows."""
    from zoneinfo import ZoneInfo

    for day in ("2018-11-04", "2018-02-17", "2022-03-27", "2022-11-06", "2011-12-30"):
        first, last = scope.StatsWindow(day, day, zone).instants()
        begin = int(datetime.fromisoformat(day + "T00:00:00+00:00").timestamp()) - 86_400
        for t in range(begin, begin + 3 * 86_400, 1800):
            at = datetime.fromtimestamp(t, ZoneInfo(zone))
            if at.date().isoformat() == day:
                assert first <= at <= last


def make(path, *statements):
    db = sqlite3.connect(path)
    for s in statements:
        db.execute(s)
    db.commit()
    db.close()


def test_databases_of_other_shapes(spark, tmp_path):
    make(tmp_path / "new.db", "CREATE TABLE responses (id TEXT, model TEXT, tokens INT)", "INSERT INTO responses VALUES ('a', 'm', 5)", "CREATE TABLE other (id TEXT, note TEXT)", "INSERT INTO other VALUES ('a', 'n')")
    make(tmp_path / "old.db", "CREATE TABLE responses (id TEXT)", "INSERT INTO responses VALUES ('b')", "CREATE TABLE other (id TEXT)", "INSERT INTO other VALUES ('b')")
    make(tmp_path / "none.db", "CREATE TABLE else_ (x)")
    (tmp_path / "broken.db").write_bytes(b"no database at all" * 100)
    query = "SELECT r.id, model, r.tokens, o.note FROM responses r JOIN other o ON o.id = r.id WHERE coalesce(tokens, 9) > 1"
    got = sqlite.tables(spark, f"{tmp_path}/*.db", query, "id string, model string, tokens double, note string").orderBy("id").collect()
    assert [(r.id, r.model, r.tokens, r.note) for r in got] == [("a", "m", 5, "n"), ("b", None, None, None)]
    bad = {r.database.rsplit("/")[-1]: r.error for r in sqlite.problems(spark, f"{tmp_path}/*.db", query).collect()}
    assert set(bad) == {"none.db", "broken.db"} and "no such table" in bad["none.db"]
    with pytest.raises(Exception, match="no such table"):
        sqlite.tables(spark, f"{tmp_path}/none.db", query, "id string", strict=True).count()


def test_older_responses(spark, tmp_path):
    make(tmp_path / "a.db", "CREATE TABLE responses (id TEXT, conversation_id TEXT, prompt TEXT, response TEXT, model TEXT, datetime_utc TEXT)", "INSERT INTO responses VALUES ('1', 'c', 'p', 'r', 'm', '2024-01-01T00:00:00')")
    got = sqlite.turns_of_responses(spark, f"{tmp_path}/a.db").collect()
    assert sorted((r.role, r.content, r.input_tokens) for r in got) == [("assistant", "r", None), ("user", "p", None)]
