"""Which pairs to compare: chains, strides, pairs not yet tested, and the first k of a category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import few
from .numbering import numbered


def chain(entries: DataFrame, *by: str) -> DataFrame:
    """Neighbours in the order of ``pos``, each pair once: entry_a, entry_b."""
    return _neighbours(entries, *by).select(*by, "entry_a", "entry_b").dropDuplicates()


def _neighbours(entries: DataFrame, *by: str) -> DataFrame:
    nxt = F.lead("entry").over(Window.partitionBy(*by).orderBy("pos"))
    return entries.select(
        *by, "pos", F.col("entry").alias("entry_a"), nxt.alias("entry_b"),
    ).where("entry_b is not null")


def chain_in_order(entries: DataFrame, *by: str) -> DataFrame:
    """The pairs of ``chain`` with their places in the order in which they were first seen, from 0 in each group."""
    first = _neighbours(entries, *by).groupBy(*by, "entry_a", "entry_b").agg(F.min("pos").alias("pos"))
    return numbered(first, ["pos", "entry_a", "entry_b"], by=by).drop("pos")


def strided(entries: DataFrame, start: int, interval: int, limit: int, *by: str) -> DataFrame:
    """From the ``start``-th on, every ``interval``-th entry with the one visited before, ``limit`` pairs at most."""
    w = Window.partitionBy(*by).orderBy("pos")
    at = entries.withColumn("_i", F.row_number().over(w) - 1).where(
        (F.col("_i") >= start) & (F.pmod(F.col("_i") - start, F.lit(interval)) == 0)
    )
    pairs = at.select(
        *by, "pos", F.lag("entry").over(w).alias("entry_a"), F.col("entry").alias("entry_b"),
    ).where("entry_a is not null and entry_a <> entry_b")
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("pos")


def all_pairs(entries: DataFrame, *by: str) -> DataFrame:
    """i < j of the few systems of ``entries`` (id)."""
    on = list(by)
    a, b = entries.select(*on, F.col("id").alias("i")), entries.select(*on, F.col("id").alias("j"))
    return (a.join(b, on) if on else a.crossJoin(few(b))).where("i < j")


def tested(comparisons: DataFrame, *by: str) -> DataFrame:
    """The pairs of ``comparisons`` (a_id, b_id), in whatever order they were compared: i < j, each once."""
    return comparisons.select(*by, F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j")).distinct()


def untested(pairs: DataFrame, seen: DataFrame, *by: str) -> DataFrame:
    """``pairs`` (i < j) without those of ``seen`` (see ``tested``); with ``by`` per group, else whatever their group."""
    return pairs.join(seen.select(*by, "i", "j"), [*by, "i", "j"], "left_anti")


def first_k(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= k)


def dense_ids(pairs: DataFrame) -> DataFrame:
    """(entry, id) by first appearance in ``pairs`` (pos, entry_a, entry_b), a before b."""
    seen = pairs.select(
        F.col("entry_a").alias("entry"), (F.col("pos") * 2).alias("p"),
    ).union(pairs.select("entry_b", F.col("pos") * 2 + 1))
    first = seen.groupBy("entry").agg(F.min("p").alias("p"))
    return numbered(first, ["p", "entry"], "id").select("entry", F.col("id").cast("int").alias("id"))
