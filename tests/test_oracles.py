"""Every evaluation query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    for f in os.listdir(SF):
        duckdb.sql(f"create or replace view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return duckdb


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
