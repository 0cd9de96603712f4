"""Hard negatives by a vector-approximation file.

Every block of vectors keeps, for each dimension, a byte that tells which of equal cells between the block's smallest
and largest value a component lies in. For a query, two tables tell the least and the largest value of each cell; looked up by
the bytes and added up over the dimensions they bound the score of every vector from below and above. Only vectors whose
bounds allow a place among the first are scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .scratch import Scratch

#: Cells of a dimension are 2 ** BITS (8 at most).
BITS = 6
#: Scores that are multiplied at a time, and the share of a tile from which a whole product is cheaper than pairs.
PAIRS, DENSE = 1 << 16, 8
NONE = np.iinfo(np.int64).min


@dataclass
class Cells:
    """The approximation of a block: codes, and the tables of the least and largest value of each cell by dimension."""

    codes: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    @staticmethod
    def of(mat: np.ndarray, bits: int) -> "Cells":
        """Equal cells between the smallest and largest value of each dimension; whole numbers, so bounds are exact."""
        low, high = (f(axis=0).astype(np.int64) if len(mat) else np.zeros(mat.shape[1], np.int64) for f in (mat.min, mat.max))
        step = ((high - low) >> bits) + 1
        least = low[:, None] + np.arange(1 << bits) * step[:, None]
        return Cells(((mat - low) // step).astype(np.uint8), least, np.minimum(least + step[:, None] - 1, high[:, None]))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every query's product with every vector."""
        at = np.arange(self.codes.shape[1])
        least, largest = (x[at, self.codes].astype(np.float64).T for x in (self.least, self.largest))
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        return up @ least + down @ largest, up @ largest + down @ least


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


class Search:
    """The first ``k`` vectors of each query and window, gathered block by block.

    ``low`` and ``high`` are (queries, windows); a score counts in a window if it lies between both, ends included.
    """

    def __init__(self, q: grid.Vectors, low: np.ndarray, high: np.ndarray, k: int):
        self.q, self.low, self.high, self.k = q, low, high, k
        self.floor = np.full(low.shape, -np.inf)  # k vectors of the window score at least this
        self.found: list[tuple] = []
        self.scored = self.met = 0

    def add(self, c: grid.Vectors, approximation: Cells) -> None:
        q, n = self.q, len(c.ids)
        own = q.rows[:, None] == c.rows[None, :]
        self.met += own.size
        wide = q.largest * c.largest * max(1, q.mat.shape[1]) >= 1 << 52
        if wide:  # bounds would need more than 53 bits: every vector is scored
            candidates = [~own & (self.low[:, j] <= self.high[:, j])[:, None] for j in range(self.low.shape[1])]
        else:
            lower, upper = approximation.bounds(q.mat)
            candidates = [self._possible(lower, upper, own, j) for j in range(self.low.shape[1])]
        some = np.logical_or.reduce(candidates)
        rows, cols = np.nonzero(some)
        if not len(rows):
            return
        self.scored += len(rows)
        if wide or len(rows) * DENSE > some.size:
            score = grid.exact_products(q, c)[rows, cols]
        else:
            score = np.empty(len(rows), np.int64)
            a, b = q.mat.astype(np.int64), c.mat.astype(np.int64)
            for i in range(0, len(rows), PAIRS):
                part = slice(i, i + PAIRS)
                score[part] = np.einsum("ij,ij->i", a[rows[part]], b[cols[part]])
        for j, mask in enumerate(candidates):
            pick = np.flatnonzero(mask[rows, cols] & (score >= self.low[rows, j]) & (score <= self.high[rows, j]))
            pick = pick[grid.first_of_groups(rows[pick], score[pick], c.ids[cols[pick]], c.rows[cols[pick]], self.k)]
            self.found.append((rows[pick], np.full(len(pick), j), score[pick], c.ids[cols[pick]], c.rows[cols[pick]]))
            full = np.bincount(rows[pick], minlength=len(q.ids)) == self.k
            least = np.full(len(q.ids), np.inf)
            np.minimum.at(least, rows[pick], score[pick].astype(np.float64))
            if not wide:
                self.floor[full, j] = np.maximum(self.floor[full, j], least[full])

    def _possible(self, lower, upper, own, j) -> np.ndarray:
        """Which vectors can be among the first of window ``j``, by their bounds."""
        low, high = (x[:, j][:, None] for x in (self.low, self.high))
        sure = np.where((lower >= low) & (upper <= high) & ~own, lower, -np.inf)
        self.floor[:, j] = np.maximum(self.floor[:, j], _kth(sure, self.k))
        return (upper >= np.maximum(low, self.floor[:, j][:, None])) & (lower <= high) & ~own

    def best(self) -> list[np.ndarray]:
        """query, window, score, id and row number of what stays."""
        parts = [np.concatenate(x) for x in zip(*self.found)] if self.found else [np.zeros(0, np.int64)] * 5
        query, window, score, ids, rows = parts
        keep = grid.first_of_groups(query * self.low.shape[1] + window, score, ids, rows, self.k)
        return [x[keep] for x in parts]


def windows(scores: np.ndarray, low: int, high: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each window, low * score <= of * x <= high * score; none where the score is NONE."""
    ends = [[(1, 0) if s == NONE else (-(-low * s // of), high * s // of) for s in row] for row in scores.tolist()]
    both = np.array(ends, object).reshape(*scores.shape, 2)
    clipped = np.clip(both, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)
    return clipped[..., 0], clipped[..., 1]


def hard_negatives(
    vectors: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    of: int = 100, key: str = "vec_id", vector: str = "vector", label: str = "label", bits: int = BITS,
    block: int = grid.BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vector`` is an array of longs without nulls. An anchor's positives are its ``positives`` first other rows of the
    same label, by inner product, ties to the smaller key. For each of them the ``negatives`` first rows of another label
    come whose score times ``of`` lies between ``low`` and ``high`` times the positive's. Rows with a null key, vector or
    label take no part; rows are known by number, so rows that repeat a key count each (anchors too); rows of other
    dimensions never meet. An anchor without another row of its label, or without a row in a window, gives none.
    Scores beyond 64 bits count as the largest or smallest number of 64 bits. Labels of any type are compared as text.

    Blocks hold one label, so positives are sought in the blocks of the label and negatives in the others. A cell of
    the grid keeps at most ``negatives`` rows a window, so no list grows with the rows that tie.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = scratch.write(
        vectors.select(
            F.col(f"`{key}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").cast("string").alias("label"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        ).where("id is not null and v is not null and label is not null")
    )
    dealt = lambda df, n: df.repartitionByRange(1 + df.count() // n, "label", "row").sortWithinPartitions("label", "row")
    blocks = scratch.write(grid.pack(dealt(rows, block), block))
    tasks = 2 * spark.sparkContext.defaultParallelism
    count = lambda df: df.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def cell(extra, take, k):
        """The function of a cell: for every tile the first ``k`` of each window in the blocks that ``take`` allows."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            candidates = [(c, Cells.of(c.mat, bits)) for c in grid.unpacked(right)]
            out = []
            for q in grid.unpacked(left, extra):
                ends = windows(q.extra, low, high, of) if extra else tuple(np.array([[x]] * len(q.ids)) for x in (NONE, -(NONE + 1)))
                search = Search(q, *ends, k)
                for c, approximation in candidates:
                    if take(q, c):
                        search.add(c, approximation)
                query, window, score, ids, numbers = search.best()
                out.append((q.rows[query], q.ids[query], window, score, ids, numbers))
            parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
            return pa.table(dict(zip(names, parts)), schema=pa.schema([(x, pa.int64()) for x in names]))

        return run

    names = ["anchor_row", "anchor_id", "slot", "score", "found_id", "found_row"]
    schema = ", ".join(f"{x} long" for x in names)
    order = [F.desc("score"), "found_id", "found_row"]

    tiles = scratch.write(grid.pack(dealt(rows.where("asks"), grid.TILE), grid.TILE))
    r, c = grid.cells(count(tiles), count(blocks), tasks)
    near = grid.meet(tiles, blocks, cell(0, lambda q, c: True, positives), schema, r, c, by=("label",))
    slot = F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order)) - 1
    near = scratch.write(near.withColumn("slot", slot).where(F.col("slot") < positives))

    by_slot = [F.max(F.when(F.col("slot") == i, F.col("score"))) for i in range(positives)]
    scores = near.groupBy("anchor_row").agg(F.array(*[F.coalesce(x, F.lit(NONE)) for x in by_slot]).alias("p"))
    asking = rows.where("asks").join(scores, F.col("row") == F.col("anchor_row"))
    tiles = scratch.write(grid.pack(dealt(asking, grid.TILE), grid.TILE, extra=positives))
    r, c = grid.cells(tiles.count(), blocks.count(), tasks)
    far = grid.meet(tiles, blocks, cell(positives, lambda q, c: q.label != c.label, negatives), schema, r, c)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "slot").orderBy(*order))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    positive = near.select(
        "anchor_row", F.col("slot").cast("long").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return far.join(positive, ["anchor_row", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
