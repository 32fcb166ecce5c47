"""Hard-negative mining: cover trees over norm-augmented candidates, best first.

Every candidate gets one more component that makes all candidates of a tree equally
long, so that an inner product is the query's length times the tree's radius times the
cosine of an angle. A node covers its candidates within a radius around its centre;
level by level that radius bounds the angles, thus the inner products, and nodes whose
bounds lie outside all of an anchor's windows are skipped with all below them. The leaves
left are visited best bound first; one that can't better the worst kept partner of any
window is skipped, and inside a leaf every inner product is taken exactly, in integers.

Rows of one vector length are dealt into blocks by a hash; a task builds the tree of one
block and searches it for one block of anchors, so neither a label nor a vector that a
third of the rows share makes a larger task. Blocks grow with the table up to
``BLOCK_CELLS`` components. Each block gives its best few partners, the best of all are
chosen by score, then smaller id.

Cases: rows with a null label, a null vector, or a null or non-finite entry take no part;
rows without id come last among ties and are never anchors; rows with a shared id are
different rows; vectors meet those of their own length; entries beyond 2**62 after
scaling count as 2**62 and scores beyond a long as the largest or smallest long; empty
vectors meet nothing; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldkpi.llm.common import stored, travels
from fieldkpi.llm.whitening import finite

travels(__name__)

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = (30, 100), (90, 100)  # window as shares of the positive's score
BLOCK_CELLS = 1 << 22
LEAST_ROWS = 2048
FAN = 16
LEAF = 64
QUERIES = 1024  # anchors searched at a time
AT_ONCE = 8  # leaves an anchor visits between two looks at its kept partners
FAR = 1 << 62
LONG = (1 << 63) - 1


def integer_rows(vectors: DataFrame, label: Column, anchor: Column, scale: int = SCALE) -> DataFrame:
    """Rows ``rid, vec_id, label, x, dim, anchor`` of usable rows; ``rid`` tells rows apart."""
    c = F.col("embedding").cast("array<double>")
    far = float(FAR)

    def whole(v: Column) -> Column:
        return F.floor(F.greatest(F.least(v * scale, F.lit(far)), F.lit(-far)))

    rows = vectors.select(
        "vec_id",
        label.cast("long").alias("label"),
        c.alias("c"),
        F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor"),
    ).where(F.col("label").isNotNull() & finite(F.col("c")))
    # Stored, so that the numbers of rows are the same at every later reading.
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("rid"),
            "vec_id",
            "label",
            F.transform("c", whole).alias("x"),
            F.size("c").alias("dim"),
            "anchor",
        ),
        "negative-rows",
    )


class CoverTree:
    """Levels of nodes; each level is a partition of all rows into runs of ``order``."""

    def __init__(self, x: np.ndarray, fan: int = FAN, leaf: int = LEAF):
        x = x.astype(float)
        square = (x * x).sum(axis=1)
        self.reach = float(np.sqrt(square.max(initial=0.0)))
        extra = np.sqrt(np.maximum(self.reach**2 - square, 0.0))
        p = np.hstack([x, extra[:, None]])
        order = np.arange(len(p))
        away = np.sqrt(((p - p[0]) ** 2).sum(axis=1))
        # Of a node: centre, covering radius, parent, first place and one past the last.
        level = [(0, float(away.max()), 0, 0, len(p))]
        self.levels = [level]
        while any(stop - start > leaf and r > 0 for _, r, _, start, stop in level):
            below = []
            for at, (centre, radius, _, start, stop) in enumerate(level):
                if stop - start <= leaf or radius == 0:
                    below.append((centre, radius, at, start, stop))
                    continue
                mine = order[start:stop]
                away = np.sqrt(((p[mine] - p[centre]) ** 2).sum(axis=1))
                near, centres = np.zeros(len(mine), int), [centre]
                # Farthest rows become centres: they stand apart by what is left to cover.
                while len(centres) < fan and away.max() > radius / 2:
                    centres.append(int(mine[int(away.argmax())]))
                    other = np.sqrt(((p[mine] - p[centres[-1]]) ** 2).sum(axis=1))
                    closer = other < away
                    near[closer], away[closer] = len(centres) - 1, other[closer]
                by = np.argsort(near, kind="stable")
                order[start:stop] = mine[by]
                ends = start + np.searchsorted(near[by], np.arange(len(centres) + 1))
                for i, c in enumerate(centres):
                    if ends[i + 1] > ends[i]:
                        cover = float(away[near == i].max())
                        below.append((c, cover, at, int(ends[i]), int(ends[i + 1])))
            level = below
            self.levels.append(level)
        self.order = order

    def bounds(self, q: np.ndarray, x: np.ndarray, level: list[tuple]):
        """Least and largest inner product that a node's rows may have with each query."""
        size = np.sqrt((q * q).sum(axis=1))[:, None] * self.reach
        centre = q @ x[[n[0] for n in level]].T
        angle = np.arccos(np.clip(centre / np.maximum(size, 1e-300), -1.0, 1.0))
        chord = np.array([n[1] for n in level]) / max(2.0 * self.reach, 1e-300)
        wide = 2.0 * np.arcsin(np.minimum(chord, 1.0))
        slack = 1e-6 * (size + 1.0)
        return (
            size * np.cos(np.minimum(angle + wide, np.pi)) - slack,
            size * np.cos(np.maximum(angle - wide, 0.0)) + slack,
        )


def search_tree(
    queries: dict[str, np.ndarray],
    rows: dict[str, np.ndarray],
    low: np.ndarray,
    high: np.ndarray,
    keep: int,
    same: bool,
) -> list[tuple[int, int, int, int]]:
    """The first ``keep`` rows in each window (``low`` to ``high``, one column each) of
    each query: query, window, row and score. Both have ``rid, label, x``; rows are in
    order of their ids. ``same`` asks for the query's label, else for others."""
    q, x = queries["x"], rows["x"]
    if not len(q) or not len(x):
        return []
    qf, xf, m = q.astype(float), x.astype(float), len(x)
    top = _largest(q) * _largest(x) * max(q.shape[1], 1)
    in_doubles = top < 1 << 53  # doubles hold every partial sum exactly
    # One number orders score and row: the better score first, then the smaller id.
    kind = np.int64 if (min(top, LONG) + 1) * m < FAR else object
    none = -FAR if kind is np.int64 else -(1 << 200)
    tree = CoverTree(xf)
    # A leaf of equal rows may be long: its runs of LEAF rows share its bounds.
    node, leaves = [], []
    for at, (_, _, _, start, stop) in enumerate(tree.levels[-1]):
        rows_of = np.sort(tree.order[start:stop])
        for i in range(0, len(rows_of), LEAF):
            node.append(at)
            leaves.append(rows_of[i : i + LEAF])
    out = []
    for start in range(0, len(q), QUERIES):
        part = slice(start, start + QUERIES)
        best = np.full((len(q[part]), low.shape[1], keep), none, dtype=kind)

        def scores(who: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            who = who + start
            if in_doubles:
                score = np.rint(qf[who] @ xf[mine].T).astype(np.int64)
            else:
                score = q[who].astype(object) @ x[mine].T.astype(object)
                score = np.clip(score, -LONG, LONG)
            alike = queries["label"][who][:, None] == rows["label"][mine][None, :]
            other = queries["rid"][who][:, None] != rows["rid"][mine][None, :]
            return score, (alike if same else ~alike) & other

        _best_first(
            tree, node, leaves, qf[part], xf, low[part], high[part], best, none, scores
        )
        who, window, place = np.nonzero(best != none)
        codes = best[who, window, place]
        rank, score = (m - 1 - codes % m).tolist(), (codes // m).tolist()
        out += zip((who + start).tolist(), window.tolist(), rank, score)
    return out


def _best_first(tree, node, leaves, q, x, low, high, best, none, scores) -> None:
    """Fill ``best`` (per query and window, worst first) from the leaves that the windows
    touch, each query's own best bound first."""
    m, keep, kind = len(x), best.shape[2], best.dtype
    low_f, high_f = low.astype(float), high.astype(float)
    windows = range(low.shape[1])
    touch = np.ones((len(q), 1), bool)
    for level in tree.levels:  # nodes that touch a window, below such nodes
        least, most = tree.bounds(q, x, level)
        touch = touch[:, [n[2] for n in level]] & np.logical_or.reduce(
            [(most >= low_f[:, w, None]) & (least <= high_f[:, w, None]) for w in windows]
        )
    least, most, touch = least[:, node], most[:, node], touch[:, node]
    visit = np.argsort(np.where(touch, -most, np.inf), axis=1, kind="stable")
    kth = np.full(low.shape, -np.inf)
    for first in range(0, len(leaves), AT_ONCE):
        some = visit[:, first : first + AT_ONCE]
        row = np.arange(len(q))[:, None]
        least_s, most_s = least[row, some], most[row, some]
        need = touch[row, some] & np.logical_or.reduce(
            [
                (most_s >= np.maximum(low_f[:, w], kth[:, w])[:, None])
                & (least_s <= high_f[:, w, None])
                for w in windows
            ]
        )
        who, place = np.nonzero(need)
        if not len(who):
            continue
        # Of every asking query, the rows of its leaves beside each other.
        asking, line = np.unique(who, return_inverse=True)
        value = np.zeros((len(asking), AT_ONCE, LEAF), kind)
        code = np.full((len(asking), AT_ONCE, LEAF), none, dtype=kind)
        leaf_of = some[who, place]
        by = np.argsort(leaf_of, kind="stable")
        ends = np.flatnonzero(np.diff(leaf_of[by])) + 1
        for group in np.split(by, ends):
            mine = leaves[leaf_of[group[0]]]
            score, allowed = scores(who[group], mine)
            score = score.astype(kind)
            value[line[group], place[group], : len(mine)] = score
            code[line[group], place[group], : len(mine)] = np.where(
                allowed, score * m + (m - 1 - mine), none
            )
        value, code = value.reshape(len(asking), -1), code.reshape(len(asking), -1)
        for w in windows:
            better = (
                (code > best[asking, w, :1])
                & (value >= low[asking, w, None])
                & (value <= high[asking, w, None])
            )
            some_better = better.any(axis=1)
            if some_better.any():
                a = asking[some_better]
                found = np.where(better[some_better], code[some_better], none)
                merged = np.concatenate([best[a, w], found], axis=1)
                if kind == np.int64:
                    merged = np.partition(merged, merged.shape[1] - keep, axis=1)[:, -keep:]
                best[a, w] = np.sort(merged, axis=1)[:, -keep:]
        full = best[:, :, 0] != none
        kth[full] = (best[:, :, 0][full] // m).astype(float)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _columns(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    x = np.vstack(rows["x"].to_numpy()).astype(np.int64)
    return {"rid": rows["rid"].to_numpy(), "label": rows["label"].to_numpy(), "x": x}


def share_windows(
    scores: list[list[int]], slots: int, low: tuple[int, int], high: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Per score s the least and largest whole number from ``low*s`` to ``high*s``; a slot
    without a score, or with an empty window, admits none."""
    lows = np.full((len(scores), slots), LONG, np.int64)
    highs = np.full((len(scores), slots), -LONG, np.int64)
    for i, row in enumerate(scores):
        for w, s in enumerate(int(v) for v in row):
            least = -((-s * low[0]) // low[1])
            most = (s * high[0]) // high[1]
            if least <= most:
                lows[i, w] = max(min(least, LONG), -LONG)
                highs[i, w] = max(min(most, LONG), -LONG)
    return lows, highs


def _block_search(keep: int, slots: int, low: tuple[int, int] | None, high: tuple[int, int] | None):
    """Function for one block of anchors and one of rows; without shares it looks for the
    best of the same label, else for those of others in the windows of ``scores``."""
    names = ["anchor", "slot", "score", "id", "no_id", "rid"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["no_id", "id", "rid"], kind="stable")
            if low is None:
                lows, highs = np.full((len(left), 1), -np.inf), np.full((len(left), 1), np.inf)
            else:
                lows, highs = share_windows(list(left["scores"]), slots, low, high)
            found = search_tree(_columns(left), _columns(right), lows, highs, keep, low is None)
            anchor, ids = left["rid"].to_numpy(), right["id"].to_numpy()
            none, rid = right["no_id"].to_numpy(), right["rid"].to_numpy()
            out = [(anchor[a], w, s, ids[r], none[r], rid[r]) for a, w, r, s in found]
        return pd.DataFrame(out, columns=names).astype(
            {"anchor": "int64", "slot": "int32", "score": "int64", "id": "int64", "no_id": "bool", "rid": "int64"}
        )

    return search


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows ``dim, nx, nq``: into how many blocks the rows and the anchors of a length go."""
    size = F.greatest(F.col("dim"), F.lit(1))
    most = F.greatest(F.floor(F.lit(BLOCK_CELLS) / size), F.lit(1))
    wanted = F.least(F.greatest(F.floor(F.col("n") / 64), F.lit(LEAST_ROWS)), most)
    return (
        rows.groupBy("dim")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a"))
        .where(F.col("a") > 0)
        .select(
            "dim",
            F.ceil(F.col("n") / wanted).cast("int").alias("nx"),
            F.ceil(F.col("a") / most).cast("int").alias("nq"),
        )
    )


def _searched(anchors: DataFrame, rows: DataFrame, blocks: DataFrame, search) -> DataFrame:
    def dealt(part: DataFrame, own: str, other: str) -> DataFrame:
        block, across = F.pmod(F.xxhash64("rid"), F.col(own)).cast("int"), F.sequence(
            F.lit(0), F.col(other) - 1
        )
        part = part.join(blocks, "dim").withColumn(own, block)
        part = part.withColumn(other, F.explode(across))
        return part.toDF(*part.columns).groupBy("dim", "nx", "nq")  # columns of its own

    kept = rows.select(
        "rid",
        F.coalesce("vec_id", F.lit(0)).alias("id"),
        F.col("vec_id").isNull().alias("no_id"),
        "label",
        "x",
        "dim",
    )
    left, right = dealt(anchors, "nq", "nx"), dealt(kept, "nx", "nq")
    return left.cogroup(right).applyInPandas(
        search, "anchor long, slot int, score long, id long, no_id boolean, rid long"
    )


def _first(found: DataFrame, *by: str, keep: int) -> DataFrame:
    """The first ``keep`` by score, then id; blocks gave as many each at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "no_id", "id", "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def mine_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW,
    high: tuple[int, int] = HIGH,
) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of
    ``integer_rows``: of each anchor and each of its first ``positives`` partners, the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` of the
    partner's."""
    rows = rows.where(F.col("dim") > 0)
    blocks = stored(_blocks(rows), "negative-blocks")
    anchors = rows.where("anchor").select("rid", "label", "x", "dim")
    best = _searched(anchors, rows, blocks, _block_search(positives, 1, None, None))
    pairs = stored(_first(best, "anchor", keep=positives), "negative-positives")
    scores = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]
    )
    asking = anchors.join(
        pairs.groupBy(F.col("anchor").alias("rid")).agg(scores.alias("scores")), "rid"
    )
    found = _first(
        _searched(asking, rows, blocks, _block_search(negatives, positives, low, high)),
        "anchor",
        "slot",
        keep=negatives,
    )
    chosen = pairs.select(
        "anchor",
        (F.col("place") - 1).alias("slot"),
        F.when(~F.col("no_id"), F.col("id")).alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    ids = rows.where("anchor").select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        found.join(chosen, ["anchor", "slot"])
        .join(ids, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("place").alias("rank"),
            F.when(~F.col("no_id"), F.col("id")).alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
