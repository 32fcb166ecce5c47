"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries become integers, so counts, sums and each row's distance from the mean are
exact. The scatter of rows centred by the exact mean is summed per task and then by
Spark; only it (the square of the vector's length, never rows) reaches the driver. Its
pivoted Cholesky factor has one column per rank; rotating pairs of columns until all
are orthogonal makes their squared lengths the eigenvalues and their directions the
components. The identity error is measured on the whitened rows by Spark.

Cases: a null vector and one with a null or non-finite entry are left out; rows without
id or with a shared id are rows like others; vectors of each length are fitted and
whitened on their own (an empty vector has no components); entries beyond 2**62 after
scaling count as 2**62, and a ``deviation`` beyond a long is null; components whose
eigenvalue is at most ``RANK_TOLERANCE`` of the largest carry rounding alone and are not
returned, so equal or single vectors give no rows; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm.common import stored, travels

travels(__name__)

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LARGEST = 1 << 62
RANK_TOLERANCE = 1e-11


class Model(NamedTuple):
    """Fit of one vector length."""

    n: int
    total: list[int]
    axes: np.ndarray  # one column per component
    values: np.ndarray
    trace: float


def finite(vector: Column) -> Column:
    return F.coalesce(
        F.forall(
            vector,
            lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c),
        ),
        F.lit(False),
    )


def scaled_integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows ``vec_id, x`` of usable vectors, ``x`` as integers."""
    c = F.col("embedding").cast("array<double>")
    far = float(LARGEST)

    def whole(v: Column) -> Column:
        return F.floor(F.greatest(F.least(v * scale, F.lit(far)), F.lit(-far))) + F.lit(shift)

    return (
        vectors.select("vec_id", c.alias("c"))
        .where(finite(F.col("c")) & (F.size("c") > 0))
        .select("vec_id", F.transform("c", whole).alias("x"))
    )


def _by_length(rows: pd.DataFrame):
    for dim, part in rows.groupby(rows["x"].map(len), sort=True):
        yield int(dim), part, np.vstack(part["x"].to_numpy()).astype(np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums without overflow: halves are summed apart."""
    high = (x >> 31).sum(axis=0)
    low = (x & ((1 << 31) - 1)).sum(axis=0)
    return [(int(h) << 31) + int(l) for h, l in zip(high, low)]


def from_mean(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n*x - total``, as int64 where that holds it, else as Python's integers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(t) for t in total)
    if most < LARGEST:
        return x * np.int64(n) - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def squared_lengths(rows: np.ndarray) -> list[int | None]:
    """Sums of squares per row; None beyond a long."""
    top = max(abs(int(rows.max())), abs(int(rows.min())))
    if top * top * rows.shape[1] < 1 << 63:
        return [int(s) for s in (rows * rows).sum(axis=1)]
    rows = rows.astype(object)
    return [s if s < 1 << 63 else None for s in map(int, (rows * rows).sum(axis=1))]


def counts_and_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By vector length, the number of rows and the exact sums of each dimension."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part, x in _by_length(batch):
                yield pd.DataFrame(
                    {
                        "dim": dim,
                        "n": len(part),
                        "i": np.arange(dim),
                        "s": [Decimal(v) for v in exact_sums(x)],
                    }
                )

    sums = (
        rows.select("x")
        .mapInPandas(partial, "dim int, n long, i int, s decimal(38,0)")
        .groupBy("dim", "i")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .collect()
    )
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["i"])):
        out.setdefault(r["dim"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def centred_scatter(
    rows: DataFrame, known: dict[int, tuple[int, list[int]]]
) -> dict[int, np.ndarray]:
    """By vector length, the covariance (divisor n); rows are centred before products."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                n, total = known[dim]
                c = (from_mean(x, n, total) / n).astype(float)
                sums[dim] = sums.get(dim, 0.0) + c.T @ c
        for dim, m in sums.items():
            yield pd.DataFrame({"dim": dim, "i": np.arange(dim), "row": list(m)})

    parts = rows.select("x").mapInPandas(partial, "dim int, i int, row array<double>")
    cells = (
        parts.select("dim", "i", F.posexplode("row").alias("j", "v"))
        .where(F.col("j") <= F.col("i"))
        .groupBy("dim", "i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    out = {}
    for dim, part in cells.groupby("dim"):
        m = np.zeros((dim, dim))
        m[part["i"], part["j"]] = part["v"]
        m[part["j"], part["i"]] = part["v"]
        out[int(dim)] = m / known[int(dim)][0]
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular ``l`` (one column per rank) and order ``p`` with
    ``a[p][:, p] = l @ l.T``."""
    d = len(a)
    a, order = a.copy(), np.arange(d)
    low = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        rest = a.diagonal()[k:]
        at = k + int(np.argmax(rest))
        if not a[at, at] > least:
            return low[:, :k], order
        if at != k:
            a[[k, at]] = a[[at, k]]
            a[:, [k, at]] = a[:, [at, k]]
            low[[k, at]] = low[[at, k]]
            order[[k, at]] = order[[at, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def jacobi_columns(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal. In each step disjoint pairs are
    rotated at once, so that every pair meets once in a sweep."""
    rank = low.shape[1]
    g = low.T.copy()  # columns as rows
    if rank % 2:
        g = np.vstack([g, np.zeros(g.shape[1])])
    m = len(g)
    seats = np.arange(m)
    least = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(m - 1):
            p, q = seats[: m // 2], seats[m // 2 :][::-1]
            x, y = g[p], g[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            go = np.abs(xy) > least * np.sqrt(xx * yy)
            if go.any():
                turned = True
                p, q, x, y = p[go], q[go], x[go], y[go]
                z = (yy[go] - xx[go]) / (2.0 * xy[go])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1.0 / np.hypot(1.0, t)
                s = (c * t)[:, None]
                c = c[:, None]
                g[p], g[q] = c * x - s * y, s * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    return g[:rank].T


def principal_axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors (columns), at most ``most``."""
    low, order = pivoted_cholesky(covariance)
    columns = jacobi_columns(low)
    values = (columns**2).sum(axis=0)
    best = np.argsort(-values, kind="stable")[:most]
    best = best[values[best] > RANK_TOLERANCE * values.max(initial=0.0)]
    axes = np.zeros((len(covariance), len(best)))
    axes[order] = columns[:, best] / np.sqrt(values[best])
    return values[best], axes


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """By vector length, its model, fitted on all rows of ``scaled_integers``."""
    known = counts_and_sums(rows)
    out = {}
    for dim, covariance in centred_scatter(rows, known).items():
        values, axes = principal_axes(covariance, components)
        if len(values):
            out[dim] = Model(*known[dim], axes, values, float(np.trace(covariance)))
    return out


def whitened_rows(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """Rows ``vec_id, dim, deviation, w``: ``w`` one whitened value per component."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part, x in _by_length(batch):
                if dim in models:
                    model = models[dim]
                    rest = from_mean(x, model.n, model.total)
                    w = (rest / model.n).astype(float) @ model.axes / np.sqrt(model.values)
                    yield pd.DataFrame(
                        {
                            "vec_id": part["vec_id"],
                            "dim": dim,
                            "deviation": pd.array(squared_lengths(rest), dtype="Int64"),
                            "w": list(w),
                        }
                    )

    # Ids travel as text: a column of longs with nulls would become doubles.
    return (
        rows.withColumn("vec_id", F.col("vec_id").cast("string"))
        .mapInPandas(project, "vec_id string, dim int, deviation long, w array<double>")
        .withColumn("vec_id", F.col("vec_id").cast("long"))
    )


def identity_errors(white: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By vector length, the largest entry of the whitened covariance minus the identity."""
    most = max((len(m.values) for m in models.values()), default=0)
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    if not pairs:
        return {}
    value = [F.get("w", F.lit(i)) for i in range(most)]
    off = [
        F.abs(F.covar_pop(value[i], value[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}")
        for i, j in pairs
    ]
    rows = white.groupBy("dim").agg(*off).collect()
    return {r["dim"]: max(v for v in r[1:] if v is not None) for r in rows}


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = scaled_integers(vectors)
    models = fit_whitening(rows, components)
    white = stored(whitened_rows(rows, models), "whitened")
    errors = identity_errors(white, models)

    def by_length(values: dict[int, float | int | list[float]], kind: str) -> Column:
        pairs = [x for dim, v in values.items() for x in (F.lit(dim), F.lit(v).cast(kind))]
        return F.create_map(*pairs)[F.col("dim")] if pairs else F.lit(None).cast(kind)

    def shares(model: Model) -> Column:
        return F.array(*[F.lit(float(e / model.trace)) for e in model.values])

    explained = (
        F.create_map(*[x for dim, m in models.items() for x in (F.lit(dim), shares(m))])[F.col("dim")]
        if models
        else F.lit(None).cast("array<double>")
    )
    return white.select(
        "vec_id",
        by_length({d: m.n for d, m in models.items()}, "long").alias("n"),
        "deviation",
        explained.alias("shares"),
        by_length(errors, "double").alias("identity_error"),
        F.posexplode("w").alias("place", "whitened"),
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("shares", F.col("place")).alias("explained"),
        "identity_error",
    )
