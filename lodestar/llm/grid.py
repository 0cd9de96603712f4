"""Vectors of whole numbers in tiles and blocks that meet on a grid: a row of cells for tiles, a column for blocks.

A tile of queries goes to every cell of its row, a block of candidates to every cell of its column, so with as many rows
as columns of cells what is shuffled grows with the square root of the number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a tile, candidates of a block, and how many of each a cell holds: its memory is bounded by them.
TILE, BLOCK, PER_CELL = 512, 4096, 16
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


@dataclass
class Vectors:
    """Vectors of one dimension and label, ascending by id and row number."""

    label: str | None
    ids: np.ndarray
    rows: np.ndarray
    mat: np.ndarray
    extra: np.ndarray | None = None

    @property
    def largest(self) -> int:
        return max(1, *(abs(int(f(initial=0))) for f in (self.mat.max, self.mat.min)))


def _narrow(mat: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    lo, hi = int(mat.min(initial=0)), int(mat.max(initial=0))
    return mat.astype(next(t for t in _WIDTHS if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def pack(rows: DataFrame, n: int, extra: int = 0) -> DataFrame:
    """Packs of at most ``n`` vectors of one label and dimension from ``rows``: id, row, v, label and, with ``extra``,
    p (an array of that many longs). A task packs what it reads; rows sorted by label fill packs best."""

    def matrix(column, pick, width):
        starts, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
        return flat[(starts[pick][:, None] + np.arange(width)).ravel()].astype(np.int64).reshape(len(pick), width)

    def out(held, at):
        parts = held.pop(at)
        ids, numbers, mat, p = (np.concatenate([x[i] for x in parts]) for i in range(4))
        o = np.lexsort((numbers, ids))
        mat = _narrow(mat[o])
        return pa.RecordBatch.from_pydict(
            {
                "label": pa.array([at[0]], pa.string()), "dim": pa.array([at[1]], pa.int32()),
                "ids": pa.array([ids[o].tobytes()], pa.binary()), "rows": pa.array([numbers[o].tobytes()], pa.binary()),
                "width": pa.array([mat.itemsize], pa.int32()), "vectors": pa.array([mat.tobytes()], pa.binary()),
                "extra": pa.array([p[o].tobytes()], pa.binary()),
            }
        )

    def run(batches):
        held: dict[tuple, list] = {}
        sizes: dict[tuple, int] = {}
        for batch in batches:
            ids, numbers = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            v, labels = batch.column(2), batch.column(3).dictionary_encode()
            dims = np.diff(v.offsets.to_numpy().astype(np.int64))
            codes = labels.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            for code, dim in np.unique(np.stack([codes, dims], 1), axis=0).tolist():
                pick = np.flatnonzero((codes == code) & (dims == dim))
                at = (None if code < 0 else labels.dictionary[code].as_py(), dim)
                p = matrix(batch.column(4), pick, extra) if extra else np.zeros((len(pick), 0), np.int64)
                mat = matrix(v, pick, dim)
                a = 0
                while a < len(pick):
                    b = min(len(pick), a + n - sizes.get(at, 0))
                    held.setdefault(at, []).append((ids[pick[a:b]], numbers[pick[a:b]], mat[a:b], p[a:b]))
                    sizes[at] = sizes.get(at, 0) + b - a
                    a = b
                    if sizes[at] == n:
                        sizes.pop(at)
                        yield out(held, at)
        for at in list(held):
            yield out(held, at)

    names = ["id", "row", "v", "label", *(["p"] if extra else [])]
    schema = "label string, dim int, ids binary, rows binary, width int, vectors binary, extra binary"
    return rows.select(*names).mapInArrow(run, schema)


def unpacked(table: pa.Table, extra: int = 0):
    """The packs of a table, one at a time."""
    for i in range(table.num_rows):
        label, dim, ids, rows, width, vectors, more = (
            table.column(x)[i].as_py() for x in ("label", "dim", "ids", "rows", "width", "vectors", "extra")
        )
        kind = next(t for t in _WIDTHS if np.dtype(t).itemsize == width)
        ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        yield Vectors(
            label, ids, rows, np.frombuffer(vectors, kind).reshape(len(ids), dim),
            np.frombuffer(more, np.int64).reshape(len(ids), extra) if extra else None,
        )


def cells(tiles: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of cells: no cell has over PER_CELL tiles or blocks on average, and there are ``tasks`` cells if
    there are that many meetings; a side is cut where the other's copies cost less."""
    r, c = max(1, -(-tiles // PER_CELL)), max(1, -(-blocks // PER_CELL))
    while r * c < min(tasks, tiles * blocks):
        if (c < blocks) and (r >= tiles or tiles * TILE <= blocks * BLOCK):
            c = min(blocks, 2 * c)
        else:
            r = min(tiles, 2 * r)
    return r, c


def meet(tiles: DataFrame, blocks: DataFrame, f, schema: str, r: int, c: int, by: tuple[str, ...] = ()) -> DataFrame:
    """What ``f(tiles, blocks)`` (two Arrow tables to one) gives for every cell of r rows and c columns.

    Every tile meets every block of equal dimension, and of equal values of ``by``, in exactly one cell.
    """
    on = ["dim", *by, "_r", "_c"]
    row, column = (F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int") for n in (r, c))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tiles.withColumn("_r", row).withColumn("_c", every(c))
    right = blocks.withColumn("_c", column).withColumn("_r", every(r))
    n = r * c if not by else max(r * c, blocks.sparkSession.sparkContext.defaultParallelism)
    left, right = (x.repartition(n, *on) for x in (left, right))  # a number that is given isn't lowered for few bytes
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(f, schema)


def exact_products(q: Vectors, c: Vectors) -> np.ndarray:
    """Inner products of all queries and candidates; beyond 64 bits they count as the largest or smallest number."""
    score = q.largest * c.largest * max(1, q.mat.shape[1])
    if score < 1 << 52:
        return (q.mat.astype(np.float64) @ c.mat.astype(np.float64).T).astype(np.int64)
    if score < 1 << 63:
        return q.mat.astype(np.int64) @ c.mat.astype(np.int64).T
    return np.clip(q.mat.astype(object) @ c.mat.astype(object).T, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def first_of_groups(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: higher scores first, then smaller ids and row numbers."""
    o = np.lexsort((rows, ids, -score, group))  # no score is the smallest number of 64 bits
    g = group[o]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return o[rank < k]
