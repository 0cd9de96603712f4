"""Row identities, and joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LARGEST = (1 << 63) - 1
#: A key with more than one in OFTEN of all rows is frequent; there are fewer than OFTEN such keys, whatever the input.
OFTEN = 1000


def join_split(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key, where a frequent key's rows stay where they are.

    ``weight`` is the number of ``rows`` a key has, ``total`` their sum. Fewer than OFTEN keys can exceed an OFTEN-th of
    the total, so the facts of these are broadcast by a proven bound; all other keys are dealt by key.
    """
    frequent = F.col(weight) * OFTEN > F.lit(total)
    few = facts.where(frequent).drop(weight)
    rare = rows.join(F.broadcast(few.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(few), on).unionByName(rare.join(facts.where(~frequent).drop(weight), on))


class Keys:
    """Numbers that order as the values of a key column do, null last: whole numbers are their own, other values are
    numbered by their place among all of them."""

    def __init__(self, values: DataFrame, key: str, scratch: Scratch):
        """``values``: a table that holds the column ``key``."""
        self.kind = dict(values.dtypes)[key]
        self.places = None
        if self.kind not in ("tinyint", "smallint", "int", "bigint"):
            places = values.select(F.col(f"`{key}`").alias("key")).where("key is not null").distinct().orderBy("key")
            self.places = scratch.write(places.withColumn("place", F.monotonically_increasing_id()))

    def numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with the key as ``key``) and the number of the key as k, null for null."""
        if self.places is None:
            return rows.withColumn("k", F.col("key").cast("long"))
        return rows.join(self.places, "key", "left").withColumnRenamed("place", "k")

    def named(self, df: DataFrame, k: str, name: str) -> DataFrame:
        """``df`` with the key of the number in its column k."""
        if self.places is None:
            return df.withColumn(name, F.col(k).cast(self.kind))
        found = self.places.select(F.col("place").alias("_place"), F.col("key").alias(name))
        return df.join(found, F.col(k) == F.col("_place"), "left").drop("_place")


class Identified:
    """``rows``: the rows of ``docs`` as row (a struct of all columns), t (the text), k and u.

    Rows of equal k and u are equal in key and text. k is the key's number, LARGEST for null keys. u is a 64-bit hash of
    the text; its sign tells null keys from the largest number, which they come after.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, scratch: Scratch):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        self.keys = Keys(docs, key, scratch)
        rows = docs.select(
            whole.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"),
        )
        u, half = F.xxhash64("t"), F.shiftrightunsigned(F.xxhash64("t"), 1)
        last = F.when(F.col("key").isNull(), half).when(F.col("k") == LARGEST, -1 - half).otherwise(u)
        self.rows = self.keys.numbered(rows).select(
            "row", "t", F.coalesce("k", F.lit(LARGEST)).alias("k"), last.alias("u"),
        )

    def named(self, df: DataFrame, k: str, u: str, name: str) -> DataFrame:
        """``df`` with the key that its columns k and u stand for."""
        df = df.withColumn("_key", F.when(~((F.col(k) == LARGEST) & (F.col(u) >= 0)), F.col(k)))
        return self.keys.named(df, "_key", name).drop("_key")
