"""Reports against their SQL on many made groups, whose figures often lie halfway between two roundings."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar import plan_queries
from lodestar.functions.stats import phi_sql
from lodestar.operators import reports

COMP = "language string, a_id int, b_id int, sentence string, sentence_category string, evaluating_model string, a_success boolean, b_success boolean, identical boolean"


def test_category_report_at_halves(spark, tmp_path, monkeypatch):
    rng, rows = random.Random(5), []
    for c in range(200):
        votes = [0] * rng.randrange(9, 40) + [1] * rng.randrange(9, 40) + [2] * rng.randrange(9)
        for k, v in enumerate(votes):
            rows.append(("L", k % 4, 4 + k % 3, str(k // 5), f"c{c}", "jA", v == 0, v == 1, v == 2))
    made = spark.createDataFrame(rows, COMP)
    path = f"{tmp_path}/made"
    made.write.parquet(path)
    monkeypatch.setattr(plan_queries.fixtures, "comparisons", lambda s, d: s.read.parquet(path))
    got = {tuple(r) for r in plan_queries.category_report(spark, "").collect()}
    sql = plan_queries.oracle(f"comp AS (SELECT * FROM '{path}/*.parquet')", phi_sql())["category_report"]
    assert len(got) == 200 and got == set(duckdb.sql(f"SELECT rank, line FROM ({sql})").fetchall())


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_numbers_round_as_in_sql(spark, digits):
    got = spark.range(4000).select((F.col("id") * 10 + 5).alias("k")).select(
        "k", reports.number(F.col("k") / 10.0 ** (digits + 1), digits).alias("x"),
    ).collect()
    want = duckdb.sql(f"SELECT printf('%.{digits}f', round((i * 10 + 5) / 1e{digits + 1}::DOUBLE, {digits})) FROM range(4000) r(i) ORDER BY i")
    assert [r.x for r in sorted(got)] == [x for x, in want.fetchall()]
