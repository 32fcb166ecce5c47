"""Embedding near-dedup: inverted lists, product-quantised residuals, exact rerank.

Equal vectors are one class, compared once. Coarse centroids and residual
codebooks are fitted on a bounded sample (``SAMPLE`` classes) of each vector length;
every class is indexed in its nearest list and asks the lists of its nearest centroids.
A pair meets if either vector asks the other's list. How many lists are asked is not
fixed but measured: sample vectors are compared with all rows, and drawn partners at the
threshold's very angle with their vectors; as many lists are asked as find ``RECALL`` of the
partners of an average sample vector and ``RECALL_AT_THRESHOLD`` of the drawn ones.

In a list the lookup tables give each code's inner product, and since a unit query cannot
gain more than the norm of what the code lost, ``table sum + lost >= threshold`` drops
no link there. What passes is compared in double precision.

A list is cut into blocks and a task compares two blocks, so a list that holds a
third of all vectors is many tasks. A task returns counts and a spanning set of
links, never all pairs. Vectors travel as the bytes of their own precision.

Cases: a null, empty, zero or non-finite vector, one with a null component, one
without id link with nothing; vectors of different lengths do not link; repeated rows are
other vectors and count as links; an empty table gives an empty result; extra
columns (labels too) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm.common import release, stored, travels
from fieldkpi.llm.components import connected_components

travels(__name__)

THRESHOLD = 0.9
SAMPLE = 40_000
SAMPLE_CELLS = 1 << 24  # components the sample may hold
LIST_ROWS = 500
# Lists grow with the rows up to the number that the sample can place.
SAMPLE_A_LIST = 4
RECALL, RECALL_AT_THRESHOLD = 0.9999, 0.999
MEASURED, DRAWN = 256, 2048
SUBSPACES = 8
CODES = 64
BLOCK = 2000
PAIRS_AT_ONCE = 200_000
ROUNDING = 1e-5  # of sums of table entries in single precision


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Rows ``cid, v, n, first_id``: one per different usable vector."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & _usable(F.col("v"))
    )
    return stored(
        rows.groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
        .select(F.xxhash64("v").alias("cid"), "v", "n", "first_id"),
        "vector-classes",
    )


def _unit(values) -> np.ndarray:
    x = np.vstack([np.asarray(v, float) for v in values])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10, spherical: bool = False) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if spherical:
            norms = np.linalg.norm(centers, axis=1, keepdims=True)
            centers = np.where(norms > 1e-12, centers / np.maximum(norms, 1e-12), centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2.0
    out = np.empty(len(x), int)
    for i in range(0, len(x), 1024):
        out[i : i + 1024] = np.argmax(x[i : i + 1024] @ centers.T - half, axis=1)
    return out


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, first: int = 0):
        self.first = first  # number of its list 0
        rng = np.random.default_rng(seed)
        self.coarse = _kmeans(sample, lists, rng, spherical=True)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        dim = sample.shape[1]
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        self.books = [
            _kmeans(rest[:, a:b], CODES, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:])
        ]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the norm of what they lose, of each unit vector."""
        at = _nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        lost = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = _nearest(part, book)
            lost += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return at, codes, np.sqrt(lost)

    def closeness(self, x: np.ndarray) -> np.ndarray:
        """Of each unit vector to each centroid, by which lists are asked."""
        return x @ self.coarse.T - (self.coarse**2).sum(axis=1) / 2.0

    def probes(self, x: np.ndarray, number: int) -> np.ndarray:
        """The ``number`` nearest lists of each unit vector."""
        number = min(number, len(self.coarse))
        out = np.empty((len(x), number), np.int32)
        for i in range(0, len(x), 1024):
            near = -self.closeness(x[i : i + 1024])
            out[i : i + 1024] = np.argpartition(near, number - 1, axis=1)[:, :number]
        return out

    def rounds_to_meet(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of unit vectors, how many lists must be asked until they meet, less one:
        the lists that are nearer to one of them than the other's own."""
        sx, sy = self.closeness(x), self.closeness(y)
        row = np.arange(len(x))
        home_x, home_y = sx.argmax(axis=1), sy.argmax(axis=1)
        ask_x = (sx > sx[row, home_y][:, None]).sum(axis=1)
        ask_y = (sy > sy[row, home_x][:, None]).sum(axis=1)
        return np.minimum(ask_x, ask_y)

    def estimates(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries and codes of one list, by table lookup, to ``ROUNDING``."""
        own = (queries @ self.coarse[which]).astype(np.float32)
        total = np.repeat(own[:, None], len(codes), axis=1)
        for m, book in enumerate(self.books):
            table = queries[:, self.cuts[m] : self.cuts[m + 1]] @ book.T
            total += np.take(table.astype(np.float32), codes[:, m], axis=1)
        return total


def fit_indexes(
    classes: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> dict[int, Index]:
    """By vector length, an index for about ``LIST_ROWS`` classes a list, with its number of
    lists to ask (``number``) and the ``recall`` measured at it. A length of one class needs none."""
    size = F.size("v")
    counts = classes.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("m"))
    out, first = {}, 0
    for dim, m in sorted(tuple(r) for r in counts.where(F.col("m") > 1).collect()):
        mine = classes.where(size == dim).orderBy(F.xxhash64("cid"), "cid")
        take = max(2, min(sample, SAMPLE_CELLS // dim))
        drawn = _unit(mine.limit(take).select("v").toPandas()["v"])
        lists = max(1, min(m // LIST_ROWS, len(drawn) // SAMPLE_A_LIST))
        out[dim] = Index(drawn, lists, first=first)
        first += lists
        out[dim].number, out[dim].recall = lists_to_ask(classes, out[dim], drawn, threshold)
    return out


def lists_to_ask(
    classes: DataFrame, index: Index, drawn: np.ndarray, threshold: float
) -> tuple[int, float]:
    """How many lists to ask, and the share of partners of a sample vector found so."""
    lists, dim = len(index.coarse), drawn.shape[1]
    rng = np.random.default_rng(11)
    x = drawn[:DRAWN]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    away /= np.where(norm > 1e-9, norm, 1.0)
    at_threshold = index.rounds_to_meet(x, threshold * x + np.sqrt(1 - threshold**2) * away)
    wanted = int(np.quantile(at_threshold, RECALL_AT_THRESHOLD, method="higher")) + 1
    queries = drawn[:MEASURED]

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            part = rows[rows["v"].map(len) == dim]
            for i in range(0, len(part), 2048):
                y = _unit(part["v"].iloc[i : i + 2048])
                score = queries @ y.T
                q, c = np.nonzero((score >= threshold) & (score < 1 - 1e-12))
                if len(q):
                    met = index.rounds_to_meet(queries[q], y[c])
                    pairs, n = np.unique(np.stack([q, met]), axis=1, return_counts=True)
                    yield pd.DataFrame({"q": pairs[0], "met": pairs[1], "n": n})

    found = (
        classes.select("v")
        .mapInPandas(partners, "q long, met long, n long")
        .groupBy("q", "met")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if len(found):
        of_query = found.groupby("q")["n"].sum()

        def recall(number: int) -> float:
            got = found[found["met"] < number].groupby("q")["n"].sum()
            return float((got.reindex(of_query.index, fill_value=0) / of_query).mean())

        while wanted < lists and recall(wanted) < RECALL:
            wanted += 1
        return min(wanted, lists), recall(min(wanted, lists))
    return min(wanted, lists), 1.0


def _by_length(indexes: dict[int, Index], rows: pd.DataFrame):
    """Parts of a batch with their index; lengths without one are left out."""
    for dim, part in rows.groupby(rows["v"].map(len)):
        if dim in indexes:
            yield indexes[dim], part, _unit(part["v"])


def _spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Ids joined by links, each with the smallest id of its group."""
    ids, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = back[: len(left)], back[len(left) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return list(zip(ids.tolist(), ids[label].tolist()))
        label = new


def _linked(q: np.ndarray, x: np.ndarray, rows, cols, threshold: float):
    """Of candidate places, those whose exact inner product reaches the threshold."""
    good = np.zeros(len(rows), bool)
    for i in range(0, len(rows), PAIRS_AT_ONCE):
        part = slice(i, i + PAIRS_AT_ONCE)
        good[part] = np.einsum("ij,ij->i", q[rows[part]], x[cols[part]]) >= threshold
    return rows[good], cols[good]


def _packed(v) -> bytes:
    """The bytes of a vector, in single precision where that is exact."""
    x = np.asarray(v, float)
    short = x.astype(np.float32)
    return short.tobytes() if np.array_equal(short, x) else x.tobytes()


def _unpacked(values, dim: int) -> np.ndarray:
    kinds = {4 * dim: np.float32, 8 * dim: np.float64}
    return _unit([np.frombuffer(b, kinds[len(b)]) for b in values])


def _knows(near: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """Whether each row (by its asked lists ``near``) asks each list of ``homes`` (sorted)."""
    at = np.clip(np.searchsorted(homes, near), 0, len(homes) - 1)
    row, place = np.nonzero(homes[at] == near)
    out = np.zeros((len(near), len(homes)), bool)
    out[row, at[row, place]] = True
    return out


def block_links(indexes: dict[int, Index], threshold: float = THRESHOLD):
    """Function for one pair of blocks: partial counts and spanning links.

    Rows of the list count for the query that asked. The query counts for a row only if
    the row does not ask the query's own list, where it will count by itself.
    """
    of_list = {k: x for x in indexes.values() for k in range(x.first, x.first + len(x.coarse))}

    def compare(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            index = of_list[int(key[0])]
            dim, which = index.coarse.shape[1], int(key[0]) - index.first
            q, x = _unpacked(queries["v"], dim), _unpacked(rows["v"], dim)
            qid, xid = queries["cid"].to_numpy(), rows["cid"].to_numpy()
            codes = np.vstack([np.frombuffer(c, np.uint8) for c in rows["codes"]])
            needed = (threshold - ROUNDING - rows["lost"].to_numpy()).astype(np.float32)
            homes, home = np.unique(queries["home"].to_numpy(), return_inverse=True)
            asks_back = _knows(np.vstack(rows["near"].to_numpy()), homes)
            to_query, to_row = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
            weight_q, weight_x = queries["n"].to_numpy(), rows["n"].to_numpy()
            joined = []
            for i in range(0, len(q), 256):
                near = index.estimates(q[i : i + 256], which, codes)
                r, c = np.nonzero(near >= needed)
                r, c = _linked(q, x, r + i, c, threshold)
                other = qid[r] != xid[c]
                r, c = r[other], c[other]
                np.add.at(to_query, r, weight_x[c])
                alone = ~asks_back[c, home[r]]
                np.add.at(to_row, c[alone], weight_q[r[alone]])
                if len(r):
                    joined += _spanning(qid[r], xid[c])
            out = [(int(i), int(i), int(k)) for i, k in zip(qid, to_query) if k]
            out += [(int(i), int(i), int(k)) for i, k in zip(xid, to_row) if k]
            if joined:
                pairs = np.array(joined, np.int64)
                out += [(a, b, 0) for a, b in _spanning(pairs[:, 0], pairs[:, 1])]
        return pd.DataFrame(out, columns=["cid", "to", "links"]).astype("int64")

    return compare


def class_links(
    classes: DataFrame, indexes: dict[int, Index], threshold: float = THRESHOLD
) -> DataFrame:
    """Rows ``cid, to, links``: links of a class to others found in one pair of blocks
    (``to`` itself), and spanning links (``links`` 0)."""

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for index, part, x in _by_length(indexes, rows):
                at, codes, lost = index.encode(x)
                near = index.probes(x, index.number) + np.int32(index.first)
                yield pd.DataFrame(
                    {
                        "cid": part["cid"],
                        "n": part["n"],
                        "v": [_packed(v) for v in part["v"]],
                        "list": at + index.first,
                        "codes": [c.tobytes() for c in codes],
                        "lost": lost,
                        "near": list(near),
                    }
                )

    columns = "cid long, n long, v binary, list int, codes binary, lost double, near array<int>"
    lists = stored(classes.mapInPandas(indexed, columns), "vector-index")
    asked = lists.select("cid", "n", "v", F.col("list").alias("home"), F.explode("near").alias("list"))
    # Blocks of a list, of queries and of rows, from the true sizes.
    # Stored, so that Spark knows their size and need not shuffle the vectors to learn it.
    blocks = stored(
        lists.groupBy("list")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("nx"))
        .join(
            lists.select(F.explode("near").alias("list"))
            .groupBy("list")
            .agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("nq")),
            "list",
        ),
        "list-blocks",
    )

    def dealt(rows: DataFrame, own: str, other: str):
        mine = F.pmod(F.xxhash64("cid"), F.col(own)).cast("int")
        rows = (
            rows.join(blocks, "list")
            .withColumn(own, mine)
            .withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))))
        )
        return rows.toDF(*rows.columns).groupBy("list", "nq", "nx")  # columns of its own

    left = dealt(asked, "nq", "nx")
    right = dealt(lists, "nx", "nq")
    return left.cogroup(right).applyInPandas(
        block_links(indexes, threshold), "cid long, to long, links long"
    )


def near_vectors(vectors: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept``, one per vector."""
    vectors = vectors.select("vec_id", "embedding")
    classes = vector_classes(vectors)
    indexes = fit_indexes(classes, sample)
    found = stored(class_links(classes, indexes), "vector-links")
    release(vectors.sparkSession)
    counts = found.where(F.col("links") > 0).groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(
        found.where(F.col("links") == 0).select(F.col("cid").alias("a"), F.col("to").alias("b"))
    )
    known = (
        classes.select("cid", "n", "first_id")
        .join(counts, "cid", "left")
        .join(groups.withColumnRenamed("id", "cid"), "cid", "left")
        .withColumn("group", F.coalesce("component", "cid"))
    )
    least = known.groupBy("group").agg(F.min("first_id").alias("component_id"))
    judged = known.join(least, "group").select(
        "cid",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        "component_id",
    )
    value = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & _usable(value)
    rows = vectors.select("vec_id", F.when(usable, F.xxhash64(value)).alias("cid"))
    return rows.join(judged, "cid", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
