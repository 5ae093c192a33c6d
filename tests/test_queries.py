"""The registered queries against their SQL."""

import os

import pytest

from lossledger import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    a, b = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    for c in a.columns:
        if a[c].dtype.kind in "iuf" and b[c].dtype.kind in "iuf":
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert rows(a) == rows(b)


def test_entry():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
