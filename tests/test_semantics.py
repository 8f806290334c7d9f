"""Hand-computed cases of the rollups, the read model and ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators import board, browse, ingest, journal, rollups, scope, search, sequences
from convolake.streaming import refresh

MSG = "id long, session_id long, ts timestamp, provider string, model string, group_key string, role string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost_cents long"


def at(s):
    return dt.datetime.fromisoformat(s)


def msg(i, s=1, ts="2024-01-01 10:00:00", g="a", role="assistant", inp=100, out=50, cost=None, model="m", provider="p"):
    return (i, s, at(ts) if ts else None, provider, model, g, role, inp, out, 0, 0, cost)


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (3, None)], "session_id long, project_id int"), spark.createDataFrame([(1, "one", "/p/one", "k")], "project_id int, project_name string, project_path string, identity_key string")


def scoped(spark, sides, rows, window=scope.StatsWindow()):
    return scope.stats_scope(scope.mark_usage_rows(spark.createDataFrame(rows, MSG)), *sides, window)


def test_usage_counts_once(spark, sides):
    t = rollups.totals(scoped(spark, sides, [msg(1), msg(2), msg(3)])).first()
    assert (t.input_tokens, t.output_tokens, t.messages, t.sessions, t.projects) == (100, 50, 1, 1, 1)


def test_same_group_in_two_sessions_is_two(spark, sides):
    assert rollups.totals(scoped(spark, sides, [msg(1), msg(2, s=2)])).first().input_tokens == 200


def test_cost_stays_null(spark, sides):
    assert rollups.totals(scoped(spark, sides, [msg(1)])).first().cost_cents is None
    t = rollups.totals(scoped(spark, sides, [msg(1, cost=5), msg(2, g="b")])).first()
    assert (t.cost_cents, t.priced_messages) == (5, 1)


def test_window_edge(spark, sides):
    rows = [msg(1, ts="2024-01-01 23:59:30", inp=1000), msg(2, ts="2024-01-02 00:00:30", inp=1000)]
    assert rollups.totals(scoped(spark, sides, rows)).first().input_tokens == 1000
    later = scope.StatsWindow("2024-01-02", "2024-01-02")
    assert rollups.totals(scoped(spark, sides, rows, later)).first().input_tokens is None


def test_zones_move_buckets(spark, sides):
    rows = [msg(1, ts="2024-01-01 23:30:00")]
    rome = rollups.daily(scoped(spark, sides, rows, scope.StatsWindow(tz="Europe/Rome"))).first()
    assert rome.date == dt.date(2024, 1, 2)
    cell = rollups.heatmap(scoped(spark, sides, [msg(1, ts="2024-01-07 05:00:00")])).first()
    assert (cell.dow, cell.hour) == (0, 5)


def test_rows_without_time_or_project(spark, sides):
    s = scoped(spark, sides, [msg(1, ts=None), msg(2, s=3, g="b")])
    assert rollups.totals(s).first().input_tokens == 200 and rollups.daily(s).count() == 1
    assert {r.project for r in rollups.top_projects(s).collect()} == {"one", "(unknown)"}


def test_bad_windows():
    for bad in ({"tz": "Mars/One"}, {"from_": "2024-02-01", "to": "2024-01-01"}, {"from_": "x"}):
        with pytest.raises(ValueError):
            scope.StatsWindow(**bad)


def test_active_minutes(spark, sides):
    rows = [msg(i, g=str(i), ts=f"2024-01-01 {t}:00") for i, t in enumerate(["10:00", "10:10", "10:10", "11:00", "11:25"])]
    assert scope.active_minutes(scoped(spark, sides, rows)).first()[0] == 35


def test_model_split_sums_to_its_parent(spark, sides):
    s = scoped(spark, sides, [msg(i, g=str(i), model=f"m{i % 3}", provider=f"p{i % 2}") for i in range(12)])
    parent = {r.provider: r.total_tokens for r in rollups.providers(s).collect()}
    parts = {r.provider: r.t for r in rollups.model_split(s, "provider").groupBy("provider").agg(F.sum("total_tokens").alias("t")).collect()}
    assert parent == parts


def test_outcomes_collapse(spark, sides):
    uses = spark.createDataFrame([(1, 1, 0, "t1", "Read", None, None, None), (1, 1, 1, "t2", "Read", None, None, True), (1, 1, 2, "t3", "Skill", "pdf", None, None)], "message_ref long, session_id long, seq int, tool_use_id string, tool_name string, skill_name string, subagent_type string, is_error boolean")
    results = spark.createDataFrame([(1, "t1", False), (1, "t1", True), (2, "t3", True)], "session_id long, tool_use_id string, is_error boolean")
    got = {(r.kind, r.name): (r.uses, r.success_rate) for r in rollups.tool_usage(scoped(spark, sides, [msg(1)]), uses, results).collect()}
    assert got == {("tool", "Read"): (2, 0.0), ("tool", "Skill"): (1, 1.0), ("skill", "pdf"): (1, 1.0)}


def test_paging():
    assert browse.page() == (50, 0) and browse.page(0, -3) == (1, 0) and browse.page(999, 7) == (200, 7)


def test_unknown_identity_matches_nothing(spark):
    p = spark.createDataFrame([("/a", "k", False), ("/b", "k", True)], "project_path string, identity_key string, git_worktree boolean")
    none = spark.createDataFrame([], "project_path string, identity_key string")
    assert browse.identity_paths(p, none, "other").count() == 0
    assert [r[0] for r in browse.identity_paths(p, none, "k", worktrees=False).collect()] == ["/a"]


def test_tail_pages(spark):
    rows = spark.createDataFrame([(1, i) for i in range(7)], "session_id long, seq int")
    pages = [[r.seq for r in browse.tail_page(rows, o, 3).orderBy("seq").collect()] for o in (0, 3, 6)]
    assert pages == [[4, 5, 6], [1, 2, 3], [0]]


def test_ingest_is_idempotent_and_whole(spark):
    cols = "session_id long, message_key string, ts timestamp"
    archive = spark.createDataFrame([(1, "a", at("2024-01-01"))], cols)
    batch = spark.createDataFrame([(1, "a", None), (1, "b", at("2024-01-02")), (1, "b", at("2024-01-03"))], cols)
    known = spark.createDataFrame([(1,)], "session_id long")
    assert [r.message_key for r in ingest.new_messages(archive, batch, known).collect()] == ["b"]
    with pytest.raises(ValueError):
        ingest.new_messages(archive, spark.createDataFrame([(9, "z", None)], cols), known)


def test_upsert_rules(spark):
    cols = "k long, root string, seen boolean, first timestamp, name string"
    old = spark.createDataFrame([(1, "r", True, at("2024-01-02"), "a"), (2, None, None, None, "b")], cols)
    new = spark.createDataFrame([(1, None, False, at("2024-01-01"), None), (3, "x", None, None, "c")], cols)
    got = {r.k: tuple(r)[1:] for r in ingest.upsert(old, new, ["k"], ["root"], ["seen"], {"first": "min"}).collect()}
    assert got == {1: ("r", True, at("2024-01-01"), None), 2: (None, False, None, "b"), 3: ("x", False, None, "c")}


def test_chunks(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate([10, 10, 90, 5, 5, 5])], "session_id long, id long, bytes long")
    assert [r.chunk for r in ingest.chunk_by_bytes(rows, 2, 50).orderBy("id").collect()] == [0, 0, 1, 2, 2, 3]


def test_logical_days(spark):
    rows = spark.createDataFrame([(1, 1, at("2024-01-02 03:59:59")), (2, 1, at("2024-01-02 04:00:00")), (3, 1, None)], "id long, session_id long, ts timestamp")
    days = journal.session_days(rows, spark.createDataFrame([(1, 5)], "session_id long, project_id int"))
    assert sorted(str(r.entry_date) for r in days.collect()) == ["2024-01-01", "2024-01-02"]
    assert journal.since_day(rows, "2024-01-02").count() == 1


def test_leader_groups_are_not_gaps(spark):
    rows = spark.createDataFrame([(1, i, at(f"2024-01-01 00:00:0{t}")) for i, t in enumerate([0, 1, 2, 3, 4, 9])], "session_id long, id long, ts timestamp")
    assert [r.leader for r in sequences.leader_groups(rows, 2).orderBy("id").collect()] == [0, 0, 0, 3, 3, 5]


def test_as_of_takes_the_last_use_before(spark):
    uses = spark.createDataFrame([("k", 1), ("k", 5), ("j", 2)], "key string, pos long")
    results = spark.createDataFrame([("k", 0), ("k", 5), ("k", 6), ("j", 9)], "key string, pos long")
    got = {(r.key, r.pos): r.use_pos for r in sequences.latest_before(results, uses, ["key"]).collect()}
    assert got == {("k", 0): None, ("k", 5): 1, ("k", 6): 5, ("j", 9): 2}


def test_trees(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (8, 9), (9, 8)], "node long, parent long")
    got = {r.node: (r.root, r.depth) for r in sequences.tree_depths(edges).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 4)}


def test_calendar_growth(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 4), (dt.date(2024, 1, 4), 6)], "day date, n long")
    got = [(r.n, r.growth_percent) for r in board.growth(board.calendar(days, "n"), "n").orderBy("day").collect()]
    assert got == [(4, 0), (0, -100), (0, 0), (6, 0)]


def test_longest_price_key_wins(spark):
    usage = spark.createDataFrame([("big-model-2", 1_000_000, 0, 10), ("other", 1_000_000, 0, 30)], "model string, input_tokens long, output_tokens long, total_tokens long")
    prices = spark.createDataFrame([("model", 1.0, 1.0), ("big-model", 5.0, 1.0)], "model string, input_rate double, output_rate double")
    costed = board.costs(usage, prices, {"input": 2.0, "output": 2.0})
    assert {r.model: r.cost for r in costed.collect()} == {"big-model-2": 5.0, "other": 2.0}
    assert board.coverage(costed).first().coverage == 0.25


def test_queries(spark):
    rows = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick: slow fox"), (3, "quicker"), (4, "brown quick")], "id long, text string")
    hits = lambda q: {r.id for r in search.keyword(rows, q).collect()}
    assert hits("quick") == {1, 2, 3, 4} and hits('"quick brown"') == {1} and hits("quick -brown") == {2}
    assert hits("slow OR brown") == {1, 2, 4} and hits("fox quick") == {1, 2}
    with pytest.raises(ValueError):
        search.keyword(rows, "  ")


def test_search_degrades(spark):
    rows = spark.createDataFrame([(1, "one two")], "id long, text string")
    hits, degraded = search.search(rows, None, "two", None, mode="hybrid")
    assert degraded and hits.count() == 1
    with pytest.raises(ValueError):
        search.search(rows, None, "two", None, mode="x")


def test_clamp_between_characters(spark):
    texts = ["a" * 10, "é" * 10, "中" * 10, "😀" * 10, "ab😀", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in range(3, 12):
        got = [r[0] for r in rows.select(T.clamp_bytes(F.col("t"), limit)).collect()]
        want = [None if t is None else t.encode()[:limit].decode("utf-8", "ignore") for t in texts]
        assert got == want, limit


def test_glob():
    assert T.glob_regex("a*b?") == "^a.*b.$" and T.glob_regex("*" * 11) is None and T.glob_regex("x" * 257) is None


def test_refresh_finds_late_rows_and_keeps_markers(spark, tmp_path):
    cols = "id long, session_id long, group_key string, ts timestamp"
    path = f"file://{tmp_path}/mirror"
    first = spark.createDataFrame([(1, 1, "a", at("2024-01-02")), (5, 1, "b", at("2024-01-02"))], cols)
    assert refresh.refresh(spark, first, path) == 2 and refresh.refresh(spark, first, path) == 0
    late = first.unionByName(spark.createDataFrame([(3, 1, "c", at("2024-01-03")), (9, 1, "a", at("2024-01-01"))], cols))
    assert refresh.refresh(spark, late, path) == 2
    assert {r.id: r.usage_row for r in spark.read.parquet(path).collect()} == {1: True, 5: True, 3: True, 9: False}
    assert refresh.lag(late, spark.read.parquet(path)).first().status == "ok"


def test_mirror_stream_adds_each_row_once(spark, tmp_path):
    src, path = f"{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.range(1, 21).select("id", (F.col("id") % 3).alias("session_id"), (F.col("id") % 4).cast("string").alias("group_key"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    rows.write.parquet(src)
    for n in range(2):
        refresh.mirror_stream(spark.readStream.schema(rows.schema).parquet(src), path, f"{tmp_path}/cp{n}").awaitTermination()
    assert spark.read.parquet(path).count() == 20


def test_streaming_windows(spark, tmp_path):
    rows = spark.createDataFrame([(at("2024-01-02 03:00:00"), 1, 5), (at("2024-01-02 05:30:00"), 1, 7)], "ts timestamp, session_id long, tokens long")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("days", refresh.daily_stream(stream)), ("sess", refresh.session_stream(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(str(r.date), r.tokens) for r in spark.table("days").collect()} == {("2024-01-01", 5), ("2024-01-02", 7)}
    assert spark.table("sess").count() == 2


def test_retries(spark):
    fails = [("a", "failed", at(f"2024-01-01 0{h}:00:00")) for h in range(5)] + [("b", "failed", at("2024-01-01 00:00:00")), ("b", "changed", at("2024-01-01 01:00:00")), ("b", "failed", at("2024-01-01 02:00:00"))]
    got = {r.key: (r.failures, r.wait_minutes) for r in refresh.retry_after(spark.createDataFrame(fails, "key string, outcome string, at timestamp")).collect()}
    assert got == {"a": (5, 60), "b": (1, 0)}
