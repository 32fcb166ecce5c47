"""Whitening against numpy's eigenvectors and exact integers, and its numeric parts."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldkpi.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, w int, dim int, x int"


def frame(spark, vectors):
    rows = [(i, v, 1, 2, 3, 4) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, total)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("shape", [(300, 12), (40, 5), (6, 9)])
def test_whitening_matches_eigenvectors(spark, shape):
    rng = np.random.default_rng(shape[0])
    mix = rng.normal(size=(shape[1], shape[1]))
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=shape) @ mix)]
    rows = whitening.whitened_components(frame(spark, vectors)).collect()
    deviation, centred, values, axes = expected([v for _, v in vectors])
    k = min(8, shape[1], shape[0] - 1)
    assert len(rows) == k * shape[0]
    mine = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, k + 1):
        own = np.array([mine[i, c].whitened for i in range(shape[0])])
        ref = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        assert np.allclose(own, ref * np.sign(own @ ref), atol=1e-8)
    for r in rows:
        assert r.n == shape[0] and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-8


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [])]
    odd = [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (202, [7.0])]
    more = [(None, good[0][1]), (3, good[3][1]), (2**60 + 1, good[4][1])]
    rows = whitening.whitened_components(frame(spark, good + bad + odd + more)).collect()
    deviation, centred, values, _ = expected([v for _, v in good + more])
    four = [r for r in rows if r.n == 33]
    assert len(four) == 33 * 4
    assert sorted(r.deviation for r in four if r.component == 1) == sorted(deviation)
    assert {2**60 + 1, None} <= {r.vec_id for r in four}
    two = [r for r in rows if r.n == 2]  # a length of its own, of rank one
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in two) == [(200, 1, 1.0), (201, 1, 1.0)]
    assert len(rows) == len(four) + len(two)  # a single vector has no component


def test_empty_and_constant_tables_give_no_rows(spark):
    assert whitening.whitened_components(frame(spark, [])).collect() == []
    same = [(i, [0.5, 0.25]) for i in range(5)]
    assert whitening.whitened_components(frame(spark, same)).collect() == []


def test_huge_entries_stay_exact_or_null(spark):
    rows = whitening.whitened_components(frame(spark, [(0, [3.0e38, 1.0]), (1, [-3.0e38, 2.0]), (2, [1.0, 0.0])])).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2}
    assert all(r.deviation is None for r in rows if r.vec_id in (0, 1))
    big = np.array([[1 << 61, 5], [1 << 61, 7], [-(1 << 60), -9]], np.int64)
    assert whitening.exact_sums(big) == [(1 << 62) - (1 << 60), 3]


@pytest.mark.parametrize("rank", [1, 4, 7])
def test_cholesky_and_jacobi(rank):
    rng = np.random.default_rng(rank)
    b = rng.normal(size=(7, rank)) * np.logspace(0, -3, rank)
    a = b @ b.T
    low, order = whitening.pivoted_cholesky(a)
    assert low.shape == (7, rank) and np.allclose(np.triu(low, 1), 0)
    assert np.allclose(low @ low.T, a[np.ix_(order, order)])
    turned = whitening.jacobi_columns(low)
    gram = turned.T @ turned
    assert np.allclose(gram, np.diag(gram.diagonal()), atol=1e-13)
    assert np.allclose(sorted(gram.diagonal()), np.linalg.eigvalsh(a)[-rank:], rtol=1e-9)
