"""Queries of fits for many systems and of what proves a fit, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import davidson as dv
from .operators import many, pairwise
from .sources import fixtures
from .sources.shared import settle

N = 8  # systems of the test facts


def _supplier_counts(s, d):
    """Every supplier is a system: two lines of an order compare theirs by quantity, 3 apart or less being a tie."""
    line = fixtures.table(s, d, "lineitem")
    a, b = (
        line.select("l_orderkey", F.col("l_suppkey").alias(i), F.col("l_quantity").alias(q)) for i, q in (("i", "a"), ("j", "b"))
    )
    gap = F.col("a") - F.col("b")
    return a.join(b, "l_orderkey").where("i < j").groupBy("i", "j").agg(
        F.count_if(gap > 3).alias("w_ij"), F.count_if(gap < -3).alias("w_ji"), F.count_if(F.abs(gap) <= 3).alias("t_ij"),
    )


def _points(fitted, *by):
    return fitted.select(*by, "i", "points", F.round("expected", 3).alias("expected"), "converged")


def supplier_strengths(s, d):
    """Points won and expected of all suppliers: equal at the maximum of the likelihood and nowhere else."""
    return _points(many.fit_many(_supplier_counts(s, d)))


def many_by_language(s, d):
    """The same for the systems of every language, all groups at once."""
    return _points(many.fit_many(pairwise.pair_counts(fixtures.comparisons(s, d), "language"), "language"), "language")


def fits_agree(s, d):
    """The two ways to fit, side by side: log strengths of every language's systems to seven digits."""
    counts = settle(pairwise.pair_counts(fixtures.comparisons(s, d), "language"))
    one = dv.fit(counts, N, "language").select("language", "i", F.col("theta").alias("a"), F.col("tie").alias("ta"))
    other = many.fit_many(counts, "language").select("language", "i", F.col("theta").alias("b"), F.col("tie").alias("tb"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-7
    return one.join(other, ["language", "i"]).select(
        "language", "i", (near("a", "b") & near("ta", "tb")).alias("agree"),
    )


def intervals_as_searched(s, d):
    """Intervals at 50 % with the covariance of a quasi-Newton search, and what its rows sum to."""
    fitted = dv.as_searched(dv.fit(pairwise.pair_counts(fixtures.comparisons(s, d), "language"), N, "language"), N)
    total = F.aggregate(F.slice("cov", 1, N), F.lit(0.0), lambda a, x: a + x)
    rows = dv.intervals(fitted.withColumn("row_sum", F.round(total, 6)), 0.5)
    return rows.select("language", "i", "low", "mid", "high", "conf_level", "covariance", "row_sum")


def covariance_check(s, d):
    """Information times covariance of every language's fit: what intervals and p-values rest on."""
    counts = settle(pairwise.pair_counts(fixtures.comparisons(s, d), "language"))
    return _proof(counts, "language")


def covariance_check_amplified(s, d):
    counts = settle(pairwise.amplified_counts(pairwise.amplify(fixtures.comparisons(s, d), "language"), "language"))
    return _proof(counts, "language")


def covariance_check_judges(s, d):
    counts = settle(pairwise.pair_counts(fixtures.comparisons(s, d), "evaluating_model").where("evaluating_model <> '483-skip'"))
    return _proof(counts, "evaluating_model")


def covariance_check_categories(s, d):
    counts = settle(pairwise.pair_counts(fixtures.comparisons(s, d), "sentence_category"))
    return _proof(counts, "sentence_category")


def _proof(counts, *by):
    found = dv.information_times_covariance(counts, settle(dv.fit(counts, N, *by)), *by)
    return found.withColumn("product", F.col("product") + 0.0)  # no negative zero


QUERIES = {f.__name__: f for f in (
    supplier_strengths, many_by_language, fits_agree, intervals_as_searched, covariance_check, covariance_check_amplified,
    covariance_check_judges, covariance_check_categories,
)}


def oracle(comp: str) -> dict[str, str]:
    systems = lambda by: f"""WITH {comp},
p AS (SELECT DISTINCT {by}, unnest([a_id, b_id]) AS i FROM votes WHERE vote IS NOT NULL AND {by} <> '483-skip')
SELECT a.{by}, a.i, b.i AS k, round(CASE WHEN a.i = b.i THEN 1 ELSE 0 END - 1.0::DOUBLE / {N}, 6) AS product
FROM p a JOIN p b ON a.{by} = b.{by}"""  # noqa: E731
    return {
        "supplier_strengths": """WITH c AS (
  SELECT x.l_suppkey AS i, y.l_suppkey AS j, x.l_quantity - y.l_quantity AS gap FROM lineitem x
    JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey),
p AS (SELECT i, CASE WHEN gap > 3 THEN 1.0 WHEN gap < -3 THEN 0.0 ELSE 0.5 END AS won FROM c
  UNION ALL SELECT j, CASE WHEN gap < -3 THEN 1.0 WHEN gap > 3 THEN 0.0 ELSE 0.5 END FROM c)
SELECT i, sum(won)::DOUBLE AS points, sum(won)::DOUBLE AS expected, true AS converged FROM p GROUP BY i""",
        "many_by_language": f"""WITH {comp},
p AS (SELECT language, a_id AS i, CASE vote WHEN 'win_a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END AS won FROM votes
  WHERE vote IS NOT NULL UNION ALL SELECT language, b_id, CASE vote WHEN 'win_b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END
  FROM votes WHERE vote IS NOT NULL)
SELECT language, i, sum(won)::DOUBLE AS points, sum(won)::DOUBLE AS expected, true AS converged FROM p GROUP BY ALL""",
        "fits_agree": f"""WITH {comp}
SELECT DISTINCT language, unnest([a_id, b_id]) AS i, true AS agree FROM votes WHERE vote IS NOT NULL""",
        "covariance_check": systems("language"),
        "covariance_check_amplified": systems("language"),
        "covariance_check_judges": systems("evaluating_model"),
        "covariance_check_categories": systems("sentence_category"),
    }
