"""Every registered query with SQL equals it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    place = [want.columns.index(n) for n in names]
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == sorted(str([r[i] for i in place]) for r in want.fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
