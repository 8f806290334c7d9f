"""Token counts of a message are read once, and lines are counted before their message is read."""

from convolake.functions import extract
from convolake.plans import archive, catalogue  # noqa: F401

RAW = [
    ('{"type":"assistant","toolUseResult":{"totalTokens":9}}', None, 9),
    ('{"type":"user","toolUseResult":{"totalTokens":8}}', 8, None),
    ('{"toolUseResult":{"totalTokens":-8}}', None, None),
    ('{"message":{"usage":{"input_tokens":-5,"output_tokens":"7"}},"toolUseResult":{"totalTokens":3}}', None, 7),
    ('{"usage":{"input_tokens":5},"content":{"usage":{"output_tokens":6}}}', 5, None),
    ('{"toolUseResult":{"usage":{"input_tokens":-1}},"content":{"usage":{"input_tokens":4,"output_tokens":"x"}}}', 4, None),
    ('{"message":{"usage":"none"},"content":{"usage":{"output_tokens":2}}}', None, 2),
    ("no json", None, None),
    (None, None, None),
]


def test_counts_are_read_once(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RAW)], "i int, raw string")
    u = rows.select("i", extract.usage_struct(rows.raw, ("input_tokens", "output_tokens")).alias("u")).select("i", "u.*")
    assert [(r.input_tokens, r.output_tokens) for r in u.orderBy("i").collect()] == [x[1:] for x in RAW]
    assert u._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 14


def test_lines_are_counted_first(spark):
    plan = catalogue.queries()["f27_usage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Aggregate", 1)[1].split("\n", 1)[1]
    assert "get_json_object" not in below and 0 < plan.count("get_json_object") <= 14
