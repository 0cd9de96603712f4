"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

DataFrame functions only. Per-document work is one projection; everything that decides targets runs on one row per
(source, hash bucket), so a source that holds a third of all rows is summed and ranked in 4096 parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: A word is a run of bytes other than space and 0x09 to 0x0D (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of sources from ``sizes`` (source, size), one row each.

    Sources in code-point order (null last) take the weights in turn. In ascending order of size by weight the
    sources that reach ``max_epochs`` times their size come first, so the redistribution that repeats until no
    target is above its cap is one running sum. Returns source, source_size, target.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
    )
    ranked = sizes.select("source", F.col("size").alias("source_size"), w.alias("w"))
    left = F.sum("source_size").over(full) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("w").over(full) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    capped = ranked.withColumn("capped", F.col("w") * left > F.lit(max_epochs) * F.col("source_size") * weight_left)
    rest = F.sum("source_size").over(full) - max_epochs * F.sum(
        F.when(F.col("capped"), F.col("source_size")).otherwise(0)
    ).over(full)
    open_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(full)
    target = F.when(
        F.col("capped"), (max_epochs * F.col("source_size")).cast("double"),
    ).otherwise(F.col("w") * rest.cast("double") / open_w)
    return capped.select("source", "source_size", target.alias("target"))


def _mixed(
    docs: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: str, key: str, text: str, source: str,
    keep: dict[str, F.Column],
) -> DataFrame:
    """The columns ``keep`` of each row, with size, source_size, target and taken."""
    scratch = Scratch(docs.sparkSession)
    own = F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
    )
    sized = docs.select(
        *[c.alias(n) for n, c in keep.items()], F.col(f"`{source}`").cast("string").alias("_source"),
        word_count(f"`{text}`").alias("_size"), F.md5(own).alias("_h"),
    )
    sized = scratch.write(sized)
    sized = sized.withColumn(
        "_s", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")),
    ).withColumn("_b", F.substring("_h", 1, 3))
    buckets = sized.groupBy("_s", "_source", "_b").agg(F.sum("_size").alias("size"))
    targets = source_targets(
        buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("size")), weights, max_epochs,
    )
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), "source_size", "target",
    )
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        "_s", "_b", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_start"),
    ).join(targets, "_s")
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    before = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    extra = F.round("target").cast("long") - F.col("_whole") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), extra - F.col("_before")))
    found = sized.join(starts, ["_s", "_b"]).withColumn("_before", before).withColumn("_whole", whole.cast("long"))
    return found.select(
        *keep, F.col("_size").alias("size"), "source_size", "target",
        (F.col("_whole") * F.col("_size") + part).cast("long").alias("taken"),
    )


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-1",
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """How many words of each row a mix takes: ``key``, size, source_size, target, taken.

    A row is repeated whole ``floor(target / source_size)`` times; the fraction that remains is taken whole from the
    rows that come first in the seeded order of their source (by md5 of seed, key and text), and the row at its end gives
    a part. The sum of ``taken`` in a source is its rounded target, no row exceeds ``max_epochs`` times its size, and
    reruns agree.

    Null text has size 0; null sources are one source; a source without words has target 0. Rows that repeat a key
    are rows of their own; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    mixed = _mixed(docs, weights, max_epochs, seed, key, text, source, {"_key": F.col(f"`{key}`")})
    return mixed.select(F.col("_key").alias(key), "size", "source_size", "target", "taken")


def repeat_rows(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-1",
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it whole; a row of which a part is taken counts as one more, a
    row without words is kept once. Each row has its own count, rows that repeat a key too."""
    mixed = _mixed(
        docs, weights, max_epochs, seed, key, text, source, {"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    )
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
