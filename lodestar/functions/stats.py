"""Normal probabilities as expressions: SQL has no error function."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

  #: Hart's rational approximation 5666 of the normal tail, highest power first, good to 15 digits up to FAR.
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
    220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948,
    440.413735824752,
)
FAR, ROOT_TWO_PI = 7.07106781186547, 2.506628274631


def normal_tail(z: Column) -> Column:
    """P(Z > |z|), with correct leading digits however small: a rational function, a continued fraction beyond FAR."""
    y = F.abs(z)
    horner = lambda cs: reduce(lambda a, c: a * y + F.lit(c), cs[1:], F.lit(cs[0]))
    fraction = reduce(lambda b, k: y + F.lit(float(k)) / b, (4, 3, 2, 1), y + 0.65)
    ratio = F.when(y < FAR, horner(NUMERATOR) / horner(DENOMINATOR)).otherwise(1.0 / (fraction * ROOT_TWO_PI))
    return F.exp(-y * y / 2.0) * ratio


def normal_cdf(z: Column) -> Column:
    return F.when(z >= 0, 1.0 - normal_tail(z)).otherwise(normal_tail(z))


#: Acklam's rational approximation of the normal quantile, highest power first; good to nine digits.
MIDDLE = (
    -39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239,
)
MIDDLE_BELOW = (
    -54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0,
)
TAIL = (
    -0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968,
    2.938163982698783,
)
TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
EDGE = 0.02425


def normal_quantile(p: Column) -> Column:
    """The z with P(Z <= z) = p: a rational approximation made exact by two Newton steps. Null outside of 0 < p < 1."""
    horner = lambda cs, x: reduce(lambda a, c: a * x + F.lit(c), cs[1:], F.lit(cs[0]))
    low = F.least(p, 1.0 - p)  # the lower tail, whose probabilities have all their digits
    r = (low - 0.5) * (low - 0.5)
    middle = (low - 0.5) * horner(MIDDLE, r) / horner(MIDDLE_BELOW, r)
    q = F.sqrt(-2.0 * F.ln(low))
    z = F.when(low < EDGE, horner(TAIL, q) / horner(TAIL_BELOW, q)).otherwise(middle)
    # the steps as a fold: z is a variable there, so the expression doesn't double with each step
    newton = lambda z, side: z - (normal_tail(z) - side) * F.lit(ROOT_TWO_PI) * F.exp(z * z / 2.0)
    z = F.aggregate(F.array(low, low), z, newton)
    return F.when((p > 0) & (p < 1), F.when(p == 0.5, 0.0).when(p < 0.5, z).otherwise(-z))


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * normal_tail(z))


def u_distribution(n: int, m: int) -> np.ndarray:
    """How many of the arrangements of n and m untied values have each U: coefficients of a Gaussian binomial, exactly."""
    n, m = min(n, m), max(n, m)
    out = np.zeros(n * m + 1, object)
    out[0] = 1
    for i in range(1, n + 1):
        out[m + i :] -= out[: len(out) - m - i].copy()
        for j in range(i):  # divide by 1 - q**i: running sums of every i-th
            out[j::i] = np.cumsum(out[j::i])
    return out


@F.pandas_udf(T.DoubleType())
def exact_u_p(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Two-sided exact p of U for samples of n and m without ties."""
    known: dict[tuple[int, int], list] = {}

    def one(u, n, m):
        if pd.isna(u):
            return None
        size = (int(min(n, m)), int(max(n, m)))
        if size not in known:
            counts = u_distribution(*size)
            known[size] = [counts[::-1].cumsum()[::-1], counts.sum()]
        tail, total = known[size]
        return min(1.0, float(2 * tail[int(max(u, n * m - u))] / total))

    return pd.Series([one(*x) for x in zip(u, n, m)], dtype="float64")


def phi_sql() -> str:
    """The same tail and distribution as SQL common tables: ``phi`` adds them to the rows of ``zs`` (z)."""
    horner = lambda cs: reduce(lambda a, c: f"({a} * y + {c!r}::DOUBLE)", cs[1:], f"{cs[0]!r}::DOUBLE")
    fraction = reduce(lambda b, k: f"(y + {k}::DOUBLE / {b})", (4, 3, 2, 1), "(y + 0.65::DOUBLE)")
    ratio = f"CASE WHEN y < {FAR!r}::DOUBLE THEN {horner(NUMERATOR)} / {horner(DENOMINATOR)} ELSE 1 / ({fraction} * {ROOT_TWO_PI!r}::DOUBLE) END"
    return (
        "ys AS (SELECT *, abs(z)::DOUBLE AS y FROM zs), "
        f"phi AS (SELECT *, CASE WHEN z >= 0 THEN 1 - tail ELSE tail END AS phi FROM (SELECT *, exp(-y * y / 2) * {ratio} AS tail FROM ys))"
    )
