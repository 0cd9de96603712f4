"""Hard negatives and top-k on the grid against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import grid, hardneg, topk

COLUMNS = "vec_id long, embedding array<float>, label int, row string, dim int, v int, ids string"


def _expected(rows, low=30, high=90, of=100, positives=5, negatives=10):
    """Every anchor by itself: exact products with all rows."""
    live = [(n, i, np.array(v, np.int64), lab) for n, (i, v, lab) in enumerate(rows) if i is not None and v is not None and lab is not None and None not in v]
    out = []
    for n, i, q, lab in live:
        if i % 100:
            continue
        scored = sorted((-int(q @ v), j, m, other) for m, j, v, other in live if m != n and len(v) == len(q))
        for s, j, _, _ in [x for x in scored if x[3] == lab][:positives]:
            window = [x for x in scored if x[3] != lab and low * -s <= of * -x[0] <= high * -s]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(window[:negatives], 1)]
    return Counter(out)


def _df(spark, rows):
    data = [(i, v, lab, "x", 7, 1, "y") for i, v, lab in rows]
    kind = COLUMNS.replace("embedding array<float>", "vector array<long>")
    return spark.createDataFrame(data, kind).repartition(3)


def _mined(spark, rows, **how):
    got = hardneg.hard_negatives(_df(spark, rows), F.col("vec_id") % 100 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("bits,block", [(1, 16), (6, 64), (8, 4096)])
def test_hard_negatives_against_brute_force(spark, bits, block):
    rng = random.Random(bits)
    vec = lambda n: [rng.randrange(-20, 60) for _ in range(n)]
    rows = [(i, vec(6), rng.choice([1, 1, 1, 2, 3])) for i in range(420)]
    hot = vec(6)
    rows += [(1000 + i, hot, i % 2) for i in range(160)]  # copies, so scores tie
    rows += [(2000, vec(6), 77), (2100, vec(3), 1), (2101, vec(3), 1), (2102, vec(3), 2), (2200, [], 1), (2201, [], 1)]
    rows += [(100, vec(6), 1), (100, vec(6), 1), (200, rows[200][1], rows[200][2]), (None, vec(6), 1), (300, None, 1), (400, vec(6), None)]
    assert _mined(spark, rows, bits=bits, block=block) == _expected(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert not _mined(spark, [])
    assert not _mined(spark, [(100, [1, 2], 1)])
    assert not _mined(spark, [(100, [1, 2], 1), (1, [3, 4], 1)])  # no other label
    assert not _mined(spark, [(100, [0, 0], 1), (200, [-1, 0], 1), (201, [1, 0], 1), (3, [7, 0], 2)]) - _expected([(100, [0, 0], 1), (200, [-1, 0], 1), (201, [1, 0], 1), (3, [7, 0], 2)])
    big = 2**40
    rows = [(100, [big, 3], 1), (1, [big, 1], 1), (2, [big // 2, 0], 2), (3, [big, 0], 2), (4, [big // 3, 9], 3)]
    # products beyond 64 bits count as its largest number, so windows are those of it
    got = _mined(spark, [(i, v, lab) for i, v, lab in rows], low=30, high=100)
    assert {(x[0], x[1], x[3]) for x in got} == {(100, 1, 2), (100, 1, 3), (100, 1, 4)}


def test_hard_negatives_with_other_windows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-9, 30) for _ in range(4)], i % 3) for i in range(300)]
    assert _mined(spark, rows, low=0, high=100, positives=2, negatives=3) == _expected(rows, 0, 100, 100, 2, 3)


@given(st.integers(1, 30), st.integers(0, 6), st.integers(1, 8), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_cells_bound_every_product(n, dim, bits, seed):
    rng = np.random.default_rng(seed)
    mat, q = rng.integers(-300, 300, (n, dim)), rng.integers(-300, 300, (7, dim))
    cells = hardneg.Cells.of(mat, bits)
    lower, upper = cells.bounds(q)
    exact = q @ mat.T
    assert (lower <= exact).all() and (exact <= upper).all() and cells.codes.max(initial=0) < 1 << bits


def test_cells_spare_most_exact_scores():
    rng = np.random.default_rng(5)
    unit = lambda n: np.floor(256 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)) + 0.3)).astype(np.int64)
    pack = lambda mat, start: grid.Vectors("a", np.arange(start, start + len(mat)), np.arange(start, start + len(mat)), mat)
    q, c = pack(unit(40), 0), pack(unit(4096), 100)
    scores = np.sort(q.mat @ c.mat.T, axis=1)[:, -5:]
    search = hardneg.Search(q, *hardneg.windows(scores, 30, 90, 100), 10)
    search.add(c, hardneg.Cells.of(c.mat, hardneg.BITS))
    assert search.scored < search.met / 4


@pytest.mark.parametrize("tiles,blocks,tasks", [(1, 1, 16), (1, 13, 16), (40, 3, 16), (1000, 5000, 64), (0, 0, 8)])
def test_grid_cells_hold_few_and_are_enough(tiles, blocks, tasks):
    r, c = grid.cells(tiles, blocks, tasks)
    assert r >= 1 and c >= 1 and tiles <= r * grid.PER_CELL and blocks <= c * grid.PER_CELL
    assert r * c >= min(tasks, tiles * blocks) and r <= max(1, tiles) and c <= max(1, blocks)


def test_topk_knows_rows_by_number(spark):
    """Rows that repeat a query's key are queries and candidates each."""
    rows = [(100, [1, 0]), (100, [0, 5]), (1, [2, 3]), (2, [7, 1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10).collect())
    assert got == sorted([(100, 1, 2, 7), (100, 2, 1, 2), (100, 3, 100, 0), (100, 1, 1, 15), (100, 2, 2, 5), (100, 3, 100, 0)])


def test_topk_with_many_tiles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grid, "TILE", 8)
    monkeypatch.setattr(grid, "PER_CELL", 2)
    rng = random.Random(2)
    rows = [(rng.randrange(0, 250), [rng.randrange(-5, 6) for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, k=4, block=16).collect()))
    want = Counter()
    for n, (i, q) in enumerate(rows):
        if i % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(rows) if m != n)[:4]
            want.update((i, r, j, -x) for r, (x, j) in enumerate(s, 1))
    assert got == want
