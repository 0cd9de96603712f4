"""Connected components by alternating large-star and small-star steps, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import join_split


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), component being the smallest node reachable.

    Each step takes the least neighbour of every node by partial aggregation and joins it back. A node with very many
    edges is not dealt by key: its minimum is broadcast to the edges. Edges never outnumber the links; stars converge in
    a logarithmic number of rounds.
    """
    edges = scratch.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen, n = None, edges.count()
    while n:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(
            both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("weight"))
        )
        large = join_split(both, low, ["u"], "weight", 2 * n).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"),
        )
        large = scratch.write(large.distinct())
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")))
        small = join_split(
            large, least, ["u"], "weight", large.count(),
        ).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        count, total = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, low, large, least)
        edges, n = new, count
        if (count, total) == seen:
            break
        seen = count, total
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
