"""Every engine query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from docsignal.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else round(float(x), 9) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
