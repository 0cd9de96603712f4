"""Round-trip coherence: two-level means over judges, then over sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import few, settle


def _iterations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tested_entry", "sentence_cat", "sentence", "depth").agg(F.avg("score").alias("m"))


def by_depth(rows: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Mean per (system, depth); depth 0 is 100 by definition."""
    if categories is not None:
        rows = rows.where(F.col("sentence_cat").isin(categories))
    means = _iterations(rows).groupBy("tested_entry", "depth").agg(F.round(F.avg("m"), 6).alias("coherence"))
    return means.unionByName(
        rows.select("tested_entry", F.lit(0).alias("depth"), F.lit(100.0).alias("coherence")).distinct()
    )


def by_category(rows: DataFrame, depth: int = 1, systems: DataFrame | None = None) -> DataFrame:
    """Mean per (system, category) at one depth; 0 where there is none."""
    at = rows.where(F.col("depth") == depth)
    systems = at.select("tested_entry").distinct() if systems is None else systems.select("tested_entry").distinct()
    at = at.join(systems, "tested_entry", "left_semi")
    means = _iterations(at).groupBy("tested_entry", "sentence_cat").agg(F.avg("m").alias("m"))
    every = systems.crossJoin(few(settle(at.select("sentence_cat").distinct())))
    return every.join(means, ["tested_entry", "sentence_cat"], "left").select(
        "tested_entry", "sentence_cat", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("coherence"),
    )


def max_depth(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("depth").alias("max_depth"), F.count_distinct("tested_entry").alias("systems"))
