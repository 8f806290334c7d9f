"""Indexes of words split each text once."""

import pytest

from convolake.operators import ranking, search


@pytest.mark.parametrize("index", [ranking.positions, search.postings])
def test_texts_are_split_before_words_are_dealt_out(spark, index):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    out = index(rows)
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    assert "split(" not in above
    assert sorted((r.token, r.id, r.length) for r in out.collect()) == [("a", 1, 3), ("b", 1, 3)]
