"""Upper-tail probabilities of the t, F and chi-square distributions.

Spark has no such functions. They run on one row per test, after aggregation,
as vectorised pandas UDFs built on the regularised incomplete beta and gamma
functions (continued fractions; see any numerical-methods text).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors need not have this package installed: its code travels with the UDFs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300


def _lgamma(values) -> np.ndarray:
    a = np.asarray(values, float)
    return np.fromiter(map(math.lgamma, a.ravel()), float, a.size).reshape(a.shape)


def _stirling_rest(z) -> np.ndarray:
    """log gamma(z) less (z - 1/2) log z - z + log(2 pi) / 2, without cancellation."""
    z = np.asarray(z, float)
    big = np.maximum(z, 16.0)
    w = 1.0 / (big * big)
    tail = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / big
    small = np.clip(z, _TINY, 16.0)
    exact = _lgamma(small) - ((small - 0.5) * np.log(small) - small + 0.5 * math.log(2 * math.pi))
    return np.where(z < 16.0, exact, tail)


def _steps(size) -> int:
    """Terms that suffice: both expansions need some multiple of the root of their size."""
    return int(500 + 60 * math.sqrt(max(1.0, float(np.max(size, initial=1.0)))))


def _beta_fraction(a, b, x, y) -> np.ndarray:
    """Even part of the continued fraction of I_x(a, b), y = 1 - x, by the Lentz recurrence.

    x enters through ``a y - b x``, its distance from the mean, so nothing cancels when a
    or b is large. NaN where it has not settled after the terms that should do.
    """
    lead = a * y - b * x + 1.0
    value = a * lead / (a + 1.0)
    value = np.where(np.abs(value) < _TINY, _TINY, value)
    c, d, settled = value, np.zeros(value.shape), np.zeros(value.shape, bool)
    for m in range(1, _steps(np.maximum(a, b))):
        odd = a + 2 * m - 1
        top = ((a + m - 1) / odd) * ((a + b + m - 1) / odd) * (m * (b - m)) * x * x
        base = m + m * (b - m) * x / odd + (a + m) / (odd + 2) * (lead + m * (1.0 + y))
        d = base + top * d
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = base + top / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = c * d
        value = np.where(settled, value, value * step)
        settled |= np.abs(step - 1.0) < 1e-15
        if settled.all():
            break
    return np.where(settled, 1.0 / value, np.nan)


def beta_inc(a, b, x, rest=None) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x where that is
    known better than by subtraction. NaN where the fraction does not settle."""
    rest = 1.0 - np.asarray(x, float) if rest is None else rest
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    mirrored = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(mirrored, b, a), np.where(mirrored, a, b)
    y, z = np.where(mirrored, rest, x), np.where(mirrored, x, rest)
    with np.errstate(all="ignore"):
        # Distances from the mean p / (p + q), so that large terms do not cancel.
        log_y = np.where(y < 0.5, np.log(y), np.log1p(-z))
        log_z = np.where(z < 0.5, np.log(z), np.log1p(-y))
        front = np.exp(
            p * (log_y + np.log1p(q / p))
            + q * (log_z + np.log1p(p / q))
            + 0.5 * (np.log(p) + np.log(q) - np.log(p + q) - math.log(2 * math.pi))
            + (_stirling_rest(p + q) - _stirling_rest(p) - _stirling_rest(q))
        )
        part = front * _beta_fraction(p, q, np.where(y > 0.0, y, 0.5), np.where(y > 0.0, z, 0.5))
    part = np.where(y <= 0.0, 0.0, part)
    return np.where(mirrored, 1.0 - part, part)


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x); NaN where it does not settle."""
    a, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, x)))
    steps = _steps(a)
    with np.errstate(all="ignore"):
        off = (x - a) / a
        front = np.exp(
            a * (np.log1p(off) - off)
            + 0.5 * (np.log(a) - math.log(2 * math.pi))
            - _stirling_rest(a)
        )
        low = x < a + 1.0
        term = 1.0 / a
        total, settled = term.copy(), ~low
        for i in range(1, steps):
            if settled.all():
                break
            term = np.where(settled, term, term * x / (a + i))
            total = np.where(settled, total, total + term)
            settled |= term < total * 1e-17
        below = np.where(settled, 1.0 - front * total, np.nan)

        # Even part of the continued fraction: b0 = x + 1 - a, then b += 2.
        b = x + 1.0 - a
        c = np.full(x.shape, 1.0 / _TINY)
        d = 1.0 / b
        h, settled = d.copy(), low.copy()
        for i in range(1, steps):
            if settled.all():
                break
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = np.where(settled, h, h * c * d)
            settled |= np.abs(c * d - 1.0) < 1e-15
        above = np.where(settled, front * h, np.nan)
    return np.where(x <= 0.0, 1.0, np.where(low, below, above))


def _ratio_tail(f, df1, df2) -> np.ndarray:
    """Chance that a variance ratio with (df1, df2) degrees of freedom exceeds f."""
    whole = df2 + df1 * f
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / whole, df1 * f / whole)


def _series(index, known, values) -> pd.Series:
    known = known & ~np.isnan(values)
    return pd.Series(np.where(known, values, np.nan), index=index).where(known, None)


def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    known = (t.notna() & df.notna()).to_numpy()
    s, v = t.fillna(0.0).to_numpy(float), df.fillna(1.0).to_numpy(float)
    return _series(t.index, known, _ratio_tail(s * s, np.ones(s.shape), v))


def f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    known = (f.notna() & df1.notna() & df2.notna() & (df1 > 0) & (df2 > 0)).to_numpy()
    w = f.fillna(0.0).to_numpy(float)
    a = np.where(known, df1.fillna(1.0).to_numpy(float), 1.0)
    b = np.where(known, df2.fillna(1.0).to_numpy(float), 1.0)
    return _series(f.index, known, _ratio_tail(w, a, b))


def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    known = (x.notna() & df.notna() & (df > 0)).to_numpy()
    s = x.fillna(0.0).to_numpy(float)
    v = np.where(known, df.fillna(1.0).to_numpy(float), 1.0)
    return _series(x.index, known, gamma_upper(v / 2.0, s / 2.0))


t_two_sided_udf = F.pandas_udf(t_two_sided, DoubleType())
f_upper_udf = F.pandas_udf(f_upper, DoubleType())
chi2_upper_udf = F.pandas_udf(chi2_upper, DoubleType())
