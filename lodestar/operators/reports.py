"""Tables as people read them: one formatted line a row, in the order of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of the lines (fixed values: widths and digits of the reports).
LEADERBOARD = "%-5d %-35s %-6s %10s %-25s"
JUDGES = "%-40s | %8s | %9d | %6s | %11s | %10s | %-6s"
CATEGORIES = "%-20s | %12s | %12s | %10s | %10s | %12s | %12s | %-6s"


def number(x: Column, digits: int, missing: str = "N/A") -> Column:
    """With so many digits, or a word where there is no number.

    The scaled double is rounded, as SQL engines do: 1.005 is a little less than it reads, and gives 1.00.
    """
    scale = 10.0 ** digits
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", F.round(x * scale) / scale))


def percent(x: Column) -> Column:
    return F.concat(number(100 * x, 2), F.lit("%"))


def _yes(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), "True").otherwise("False")


def leaderboard(records: DataFrame, *by: str) -> DataFrame:
    """Best to worst: rank and line of ``davidson.records``."""
    ci = F.concat(
        F.lit("["), number(F.col("intervals.low"), 2), F.lit(" - "), number(F.col("intervals.high"), 2), F.lit("]"),
    )
    temp = F.coalesce(F.col("model.temp").cast("string"), F.lit("None"))
    line = F.format_string(
        LEADERBOARD, "rank", F.coalesce("model.model_name", F.lit("N/A")), temp,
        number(F.col("intervals.mid"), 2, "nan"), ci,
    )
    return records.select(*by, "rank", line.alias("line")).orderBy(*by, "rank")


def judges(analysis: DataFrame) -> DataFrame:
    """Judges by agreement: rank and line of ``davidson.judge_analysis``."""
    line = F.format_string(
        JUDGES, "judge", percent(F.col("agreement_rate")), "decisions", percent(F.col("tie_rate")),
        number(F.col("pearson"), 3), number(F.col("spearman"), 3),
        _yes(F.col("model_fitted")),
    )
    return analysis.select("rank", line.alias("line")).orderBy("rank")


def categories(signal: DataFrame) -> DataFrame:
    """Categories by signal: rank and line of ``davidson.category_signal``; model figures that aren't there read 0."""
    zero = lambda c, digits: number(F.coalesce(c, F.lit(0.0)), digits)
    c = F.col
    line = F.format_string(
        CATEGORIES, "sentence_category", zero(c("signal"), 3), zero(c("agreement"), 3), zero(c("decisiveness"), 3),
        zero(c("spread"), 4), zero(c("width"), 4),
        zero(c("significant"), 3), _yes(c("model_fitted")),
    )
    return signal.select("rank", line.alias("line")).orderBy("rank")
