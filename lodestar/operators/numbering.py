"""Places in an order, counted by all tasks at once: range partitions are sorted and counted, then offset.

No window gathers the rows: only one count for each partition comes together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle


def numbered(rows: DataFrame, order: list, name: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the place (from 0) that each has in ``order`` (columns or expressions), in its group of ``by``.

    Rows that are equal in all of ``order`` get adjacent places in any order, so it should tell all rows apart. Nulls come
    first. An empty table stays empty.
    """
    keys = [*by, *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = settle(spread.withColumn("_m", F.monotonically_increasing_id()))  # partition and place in it, 33 bits
    sizes = sorted(tuple(r) for r in local.groupBy(F.shiftright("_m", 33)).agg(F.count("*")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    first = local.sparkSession.createDataFrame(offsets, "_part long, _before long")
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    out = local.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(first), "_part")
    out = out.withColumn(name, F.col("_before") + within).drop("_part", "_before", "_m")
    if not by:
        return out
    starts = out.groupBy(*by).agg(F.min(name).alias("_start"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    met = out.alias("o").join(starts.alias("s"), same)
    return met.select(*[F.col(f"o.{c}") for c in rows.columns], (F.col(name) - F.col("_start")).alias(name))
