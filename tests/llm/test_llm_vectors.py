"""Exact top-k search and hard negatives against all pairs, with the edge cases their docstrings state."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skiff.llm import hard_negatives, segment_search, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell long, vec array<int>"


def integers(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return tuple(math.floor(256 * float(np.float32(x))) for x in v)


def one_each(rows):
    """The least (vector, label) of each id that takes part."""
    out = {}
    for i, v, label in rows:
        v = integers(v)
        if i is not None and v is not None:
            out[i] = min(out.get(i, (v, label)), (v, label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def first(score, ids, k):
    return sorted(ids, key=lambda i: (-score[i], i))[:k]


def all_top(rows, every, k):
    kept = one_each([(i, v, 0) for i, v, _ in rows])
    out = set()
    for i, (q, _) in kept.items():
        if i % every == 0:
            score = {j: product(q, v) for j, (v, _) in kept.items() if j != i and len(v) == len(q)}
            out |= {(i, r + 1, j, score[j]) for r, j in enumerate(first(score, score, k))}
    return out


def all_negatives(rows, every, k):
    kept = one_each([r for r in rows if r[2] is not None])
    out = set()
    for i, (q, label) in kept.items():
        if i % every == 0:
            score = {j: product(q, v) for j, (v, _) in kept.items() if j != i and len(v) == len(q) and len(v)}
            for p in first(score, [j for j in score if kept[j][1] == label], k):
                ok = [j for j in score if kept[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
                out |= {(i, p, r + 1, j, score[p], score[j]) for r, j in enumerate(first(score, ok, k))}
    return out


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        v = centres[i % 4] * rng.choice([0.2, 1.0]) + rng.normal(size=width) * rng.choice([0.05, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v / 4], int(rng.integers(0, 3))))
    return rows


def odd_rows(width):
    """Ties, copies, repeated ids and rows, nulls, other widths, zeros and empty vectors."""
    same = [0.5] * width
    return [
        (1000, same, 1), (1001, same, 1), (1002, same, 2), (1003, same, 2), (1004, same, None), (1004, same, None), (1005, same, 1), (1005, same, 1),
        (1006, [0.25] * width, 2), (1006, same, 1), (1007, None, 1), (1008, [None] + same[1:], 1), (1009, [float("nan")] + same[1:], 1),
        (1010, [float("inf")] + same[1:], 1), (None, same, 1), (None, same, 1), (1012, [], 1), (1014, [], 2), (1016, [1.0], 1), (1018, [2.0], 1), (1020, [2.0], 2),
        (1022, [0.0] * width, 1), (1024, [0.0] * width, 2), (1026, [-x for x in same], 1), (-4, same, 2), (-2, same, 1),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, [1]) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("width", [1, 3, 16, 33])
def test_search_and_negatives_equal_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 64)
    monkeypatch.setattr(vectors, "CELL", 64 * width)  # several blocks of queries and of rows
    monkeypatch.setattr(segment_search, "TILE", 1000)
    monkeypatch.setattr(hard_negatives, "MOST_ROWS", 40)
    rows = clustered(300, width, width) + odd_rows(width)
    random.Random(1).shuffle(rows)
    df = frame(spark, rows)
    got = segment_search.search(df, F.col("vec_id") % 2 == 0, k=4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == all_top(rows, 2, 4)
    got = hard_negatives.mine(df, F.col("vec_id") % 2 == 0, k=3).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == all_negatives(rows, 2, 3)


def test_few_rows_and_empty_tables(spark):
    none = frame(spark, [])
    assert segment_search.search(none, F.col("vec_id") % 2 == 0).collect() == []
    assert hard_negatives.mine(none, F.col("vec_id") % 2 == 0).collect() == []
    alone = frame(spark, [(0, [1.0, 2.0], 1)])
    assert segment_search.search(alone, F.col("vec_id") % 2 == 0).collect() == []
    assert hard_negatives.mine(alone, F.col("vec_id") % 2 == 0).collect() == []
    two = frame(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 0.0], 2)])
    assert [tuple(r) for r in segment_search.search(two, F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1, 65536)]
    assert hard_negatives.mine(two, F.col("vec_id") % 2 == 0).collect() == []  # no positive


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2.0**20 + i), float(2.0**18 * i)], i % 2) for i in range(12)]
    got = {tuple(r) for r in segment_search.search(frame(spark, rows), F.col("vec_id") % 2 == 0).collect()}
    assert got == all_top(rows, 2, 5)
    huge = frame(spark, [(0, [1e30], 1), (1, [1e30], 1)])
    with pytest.raises(Exception, match="don't fit a long"):
        segment_search.search(huge, F.col("vec_id") % 2 == 0).collect()


def test_bounds_never_fall_below_the_score():
    rng = np.random.default_rng(5)
    for width in (1, 2, 7, 64):
        q, x = (np.floor(rng.normal(size=(40, width)) * 100) for _ in range(2))
        exact = q @ x.T
        last = None
        for s in segment_search.resolutions(width):
            bound = segment_search.statistics(q, s) @ segment_search.statistics(x, s).T
            assert (bound >= exact - 1e-6).all()
            last = bound
        assert (last - exact).mean() <= (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None] - exact).mean() + 1e-6


def test_feasible_ranges_keep_every_row_that_reaches_the_threshold():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(400, 12)) * rng.choice([20, 200], size=(400, 1)))
    x[:200] += 300 * (np.arange(12) == 3)
    q = np.floor(rng.normal(size=12) * 50 + 200 * (np.arange(12) == 3))
    size = float(np.sqrt((q**2).sum()))
    left_out = 0
    for b in hard_negatives.buckets(np.arange(400), x):
        for least in (1.0, 1e4, 3e4, 6e4, 9e4):
            got = b.feasible(q / size, np.argsort(-np.abs(q))[:4], size, least)
            assert set(b.rows[x[b.rows] @ q >= least]) <= set(got)
            left_out += len(b.rows) - len(got)
    assert left_out > 400  # and does leave rows out
