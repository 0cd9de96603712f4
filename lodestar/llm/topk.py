"""Exact top-k search: products of query tiles and candidate blocks, a selection per tile, and a tree merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .scratch import Scratch


def _best(q: grid.Vectors, c: grid.Vectors, k: int):
    """Row and column numbers and scores of each query's k best candidates of a block, ties to the smaller id."""
    n = len(c.ids)
    keys = grid.exact_products(q, c)
    own = q.rows[:, None] == c.rows[None, :]
    if q.largest * c.largest * max(1, q.mat.shape[1]) * (n + 1) < 1 << 62:
        ranked = keys * n + (n - 1 - np.arange(n))
        ranked[own] = np.iinfo(np.int64).min
        m = min(k, n)
        top = np.argpartition(ranked, n - m, axis=1)[:, n - m :] if m < n else np.tile(np.arange(n), (len(q.ids), 1))
    else:
        top = np.stack([np.lexsort((np.arange(n), -row))[: k + 1] for row in keys])
    rows = np.repeat(np.arange(len(q.ids)), top.shape[1])
    cols = top.ravel()
    keep = ~own[rows, cols]
    return rows[keep], cols[keep], keys[rows[keep], cols[keep]]


def top_k(
    vectors: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", vector: str = "vector",
    block: int = grid.BLOCK,
) -> DataFrame:
    """The k highest integer inner products of every query row with every other row: query_id, rank, vec_id, score.

    ``vector`` is an array of longs without nulls. Every tile of queries meets every block of candidates in one cell of
    a grid, which selects k rows a query; the lists of a query's cells merge by rank. Ties go to the smaller key. Rows
    are known by a number, not by their key: rows that repeat a query's key are queries and candidates each, and only
    the query's own row is left out. Rows with a null key or vector take no part, rows of other dimensions none in a
    query. Scores beyond 64 bits count as the largest or smallest number of 64 bits. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.write(
        vectors.select(
            F.col(f"`{key}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.col(f"`{vector}`").alias("v"), F.lit(None).cast("string").alias("label"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ).where("id is not null and v is not null")
    )
    tiles = scratch.write(grid.pack(rows.where("asks").coalesce(1 + rows.count() // (1 << 22)), grid.TILE))
    blocks = scratch.write(grid.pack(rows, block))
    r, c = grid.cells(tiles.count(), blocks.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism)

    def products(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {x: [] for x in ("query_row", "query_id", "row", "vec_id", "score")}
        queries = list(grid.unpacked(left))
        for candidates in grid.unpacked(right):
            for q in queries:
                at, cols, score = _best(q, candidates, k)
                for name, x in zip(found, (q.rows[at], q.ids[at], candidates.rows[cols], candidates.ids[cols], score)):
                    found[name].append(x)
        if not found["row"]:
            return schema.empty_table()
        out = {name: np.concatenate(x) for name, x in found.items()}
        top = grid.first_of_groups(out["query_row"], out["score"], out["vec_id"], out["row"], k)
        return pa.table({name: x[top] for name, x in out.items()}, schema=schema)

    schema = pa.schema([(x, pa.int64()) for x in ("query_row", "query_id", "row", "vec_id", "score")])
    part = grid.meet(tiles, blocks, products, "query_row long, query_id long, row long, vec_id long, score long", r, c)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return part.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantised(
    embeddings: DataFrame, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
) -> DataFrame:
    """The key, the columns ``keep``, and floor(scale * x) of every component as longs; rows with null or non-finite
    components, or null, are left out."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return embeddings.where(x.isNotNull() & ~bad).select(
        F.col(key), *[F.col(f"`{c}`") for c in keep],
        F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("vector"),
    )
