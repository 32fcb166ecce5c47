"""Hard negatives against all pairs; tree invariants; ties, copies and edge rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldkpi.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, x int, rid int, dim string"


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v, l, 0, 1, "c") for i, v, l in rows], SCHEMA).repartition(3)
    ints = negatives.integer_rows(df, F.col("label"), F.col("vec_id") % 10 == 0)
    got = negatives.mine_negatives(ints, **how).collect()
    none = (math.inf,)
    key = lambda r: tuple(none if v is None else (v,) for v in r)
    return sorted((tuple(r) for r in got), key=key)


def brute(rows, positives=5, negatives=10):
    usable = [
        (i, [math.floor(256 * c) for c in v], l)
        for i, v, l in rows
        if l is not None and v and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for n, (a, x, label) in enumerate(usable):
        if a is None or a % 10:
            continue
        pairs = [
            (sum(p * q for p, q in zip(x, y)), i, l == label)
            for m, (i, y, l) in enumerate(usable)
            if m != n and len(y) == len(x)
        ]
        for score, i, _ in sorted((p for p in pairs if p[2]), key=order)[:positives]:
            fits = [p for p in pairs if not p[2] and 30 * score <= 100 * p[0] <= 90 * score]
            for rank, (s, j, _) in enumerate(sorted(fits, key=order)[:negatives], 1):
                out.append((a, i, rank, j, score, s))
    none = (math.inf,)
    return sorted(out, key=lambda r: tuple(none if v is None else (v,) for v in r))


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, dim))
    v = heads[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    return [(i, [float(c) for c in x], int(rng.integers(0, 4))) for i, x in enumerate(v)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_matches_all_pairs_over_many_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 70)
    monkeypatch.setattr(negatives, "BLOCK_CELLS", 8 * 90)
    rows = vectors(700, 8, 3, spread)
    assert mined(spark, rows) == brute(rows)


def test_ties_copies_and_shared_or_missing_ids(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(150)]  # one vector, all scores equal
    rows += [(i, [0.5, 0.25], i % 2) for i in range(150, 260)]
    rows += [(10, [1.0, 0.5], 0), (None, [1.0, 0.5], 1), (None, [0.9, 0.4], 0)]
    assert mined(spark, rows) == brute(rows)
    few = [(0, [1.0], 1), (None, [1.0], 1), (None, [0.5], 2), (3, [0.5], 2), (4, [1.0], 2)]
    assert mined(spark, few) == brute(few)
    assert [r[3] for r in mined(spark, few)] == [3, None]


def test_rows_that_take_no_part(spark):
    rows = vectors(60, 3, 1)
    bad = [(10, None, 1), (20, [1.0, None, 2.0], 1), (30, [math.nan, 0.0, 0.0], 1), (40, [math.inf, 0.0, 0.0], 1)]
    bad += [(50, [1.0, 1.0, 1.0], None), (70, [], 1), (80, [1.0, 2.0], 1), (81, [1.0, 2.0], 1), (82, [0.5, 1.0], 2)]
    assert mined(spark, rows + bad) == brute(rows + bad)
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0], 1)]) == []


def test_huge_entries_are_compared_exactly_within_a_long(spark):
    rows = [(0, [2.0**20, 1.0], 1), (1, [2.0**21, 1.0], 1), (2, [2.0**20, 3.0], 2), (3, [2.0**20, 2.0], 2)]
    assert mined(spark, rows) == brute(rows)
    far = [(0, [1e300, 0.0], 1), (1, [1e300, 0.0], 1), (2, [1.0, 0.0], 2)]
    assert mined(spark, far) == []  # the negative's score is far below its window


def test_negative_positives_have_no_window(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (3, [0.5, 0.0], 2)]
    assert mined(spark, rows) == brute(rows) == []


@pytest.mark.parametrize("dim", [1, 3, 20])
def test_cover_tree_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(500, dim)) * 100)
    x[:200] = x[0]
    q = np.round(rng.normal(size=(7, dim)) * 100)
    tree = negatives.CoverTree(x, fan=4, leaf=8)
    assert sorted(tree.order) == list(range(500))
    for level in tree.levels:
        assert [n[3] for n in level] == [0] + [n[4] for n in level[:-1]] and level[-1][4] == 500
        low, high = tree.bounds(q, x, level)
        for at, (_, _, _, start, stop) in enumerate(level):
            scores = q @ x[tree.order[start:stop]].T
            assert (scores >= low[:, at, None]).all() and (scores <= high[:, at, None]).all()
    assert all(n[4] - n[3] <= 8 or n[1] == 0 for n in tree.levels[-1])


def test_tight_clusters_are_skipped():
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(8, 16)) * 100
    x = np.round(np.repeat(heads, 200, axis=0) + rng.normal(size=(1600, 16)))
    tree = negatives.CoverTree(x)
    low, high = tree.bounds(np.round(heads[:1]), x, tree.levels[-1])
    own = float(heads[0] @ heads[0])
    rows = np.array([n[4] - n[3] for n in tree.levels[-1]])
    skipped = ((high < 0.9 * own) | (low > 1.1 * own))[0]
    assert rows[skipped].sum() == 1400  # all rows of the seven other clusters
