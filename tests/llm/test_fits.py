"""Models and budgets against what enumeration and differences say."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from fieldkpi.llm import mixing, severity

L2 = 1e-3


def test_large_budgets_keep_the_proportions():
    sizes, counts = list(range(1, 200)), [50] * 199
    total = sum(s * c for s, c in zip(sizes, counts))
    taken = mixing.fill_budget(sizes, counts, total // 2 + 1, cap=4096)
    assert sum(s * t for s, t in zip(sizes, taken)) == total // 2 + 1
    assert sum(abs(t - 25) > 3 for t in taken) < 20


def loss(params, rows, cols, vals, grades, n_cols):
    """Mean cumulative-link loss with the ridge, from its definition."""
    w, first, gaps = params[:n_cols], params[n_cols], np.exp(params[n_cols + 1 :])
    theta = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
    total = 0.0
    for i, g in enumerate(grades):
        mine = rows == i
        score = (vals[mine] * w[cols[mine]]).sum()
        high, low = (1 / (1 + np.exp(-(t - score))) for t in (theta[g + 1], theta[g]))
        total -= np.log(max(high - low, 1e-300))
    return total / len(grades) + L2 / 2 * (w**2).sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_ordinal_fit_is_where_differences_vanish(seed):
    rng = np.random.default_rng(seed)
    n, k = 80, 4
    x = rng.normal(size=(n, k)) * (rng.random((n, k)) < 0.7)
    score = x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.logistic(size=n)
    grades = np.digitize(score, [-0.5, 0.8, 2.0])
    rows, cols = np.nonzero(x)
    weights, cuts = severity.fit_ordinal(rows, cols, x[rows, cols], grades, k, l2=L2, steps=4000, rate=0.02)
    assert (np.diff(cuts) > 0).all()
    params = np.concatenate([weights, cuts[:1], np.log(np.diff(cuts))])
    at = lambda p: loss(p, rows, cols, x[rows, cols], grades, k)
    for i in range(len(params)):
        step = np.zeros(len(params))
        step[i] = 1e-4
        assert abs(at(params + step) - at(params - step)) / 2e-4 < 2e-3, i
        assert at(params + 1000 * step) > at(params) - 1e-6 and at(params - 1000 * step) > at(params) - 1e-6


def test_no_word_tells():
    rows, words = np.array([0, 1, 2, 3]), np.array([0, 0, 0, 0])
    toxic = np.array([1, 1, 0, 0])
    assert not severity.telling(rows, words, toxic).any()
    none = np.zeros(0, int)
    assert severity.telling(none, none, toxic).shape == (0,)
    assert severity.derive_grades(none, none, none.astype(float), toxic).tolist() == [1, 1, 0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_budget_is_as_near_as_any_choice(seed):
    """Every way to take documents by length: none comes nearer from below."""
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.choice(np.arange(2, 30), 4, replace=False).tolist())
    counts = rng.integers(1, 4, 4).tolist()
    sums = {sum(s * c for s, c in zip(sizes, t)) for t in product(*(range(c + 1) for c in counts))}
    for budget in range(0, sum(s * c for s, c in zip(sizes, counts)) + 3):
        taken = mixing.fill_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        got = sum(s * t for s, t in zip(sizes, taken))
        assert got == max(v for v in sums if v <= budget)
