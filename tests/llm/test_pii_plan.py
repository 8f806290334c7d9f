"""The driver holds, prints and plans each expression many times, so that those of surrogates must stay small."""

from convolake.llm import pii


def test_surrogates_draw_by_one_expression(spark, capsys):
    keys = spark.createDataFrame([("email", "a@b.org", 0)], "kind string, canon string, attempt int")
    pii._surrogates(keys, "key").explain(mode="simple")
    assert len(capsys.readouterr().out) < 20_000
