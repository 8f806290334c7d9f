"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from convolake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cur = con.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr([plain(dict(zip(cols, r))[c]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want
