"""Near-duplicates of whole texts by SetSketch registers, with exact confirmation.

A text's set of k-word shingles becomes ``REGISTERS`` registers. Register i keeps
floor(C - log_b of the least of the exponential values its shingles get); the sketch of a
union is the register-wise maximum. Bands of ``ROWS`` registers find candidates:
a pair of similarity 0.8 shares none of the 40 bands with a chance of 5e-6, while unlike
sets share one so rarely (5e-11) that buckets do not fill with the corpus. The likelihood of
how many registers are greater, equal and less gives a pair's similarity; pairs too
far below the threshold go, the rest are compared on their full sets.

Copies with equal sets are one class. Groups are joined in rounds: first each bucket's
members meet its smallest id, later only members of different components meet,
and in a large bucket they do so block by block. So thousands of near copies cost a few
comparisons each, and no link between different components is lost.

Cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text with fewer than k words is one shingle; rows without id have no
component and are kept; rows that share an id share its answer; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.llm import wordhash
from fieldkpi.llm.common import fresh, release, stored, travels
from fieldkpi.llm.components import connected_components

travels(__name__)
travels(wordhash.__name__)

REGISTERS = 240
ROWS = 6
BAND_BITS = np.uint64(63)
# Documents left in buckets of several components get this many, to be told apart finely.
FINE_REGISTERS = 1024
BASE = 1.08
OFFSET = 40.0
PERCENT = 80
# Errors an estimate at similarity 0.8 is allowed, in standard deviations.
ERRORS = 4.5
GROUP_ROWS = 20_000
BLOCK = 1000

_rng = np.random.default_rng(20240131)
_SHIFTS, _FACTORS, _FACTORS_2 = (
    _rng.integers(0, 1 << 32, FINE_REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(one)
    for one in (0, 1, 1)
)
SKETCH_SCHEMA = "doc_id long, n_shingles long, key_a long, key_b long, registers binary"


def registers_of(
    row: np.ndarray, value: np.ndarray, rows: int, count: int = REGISTERS
) -> np.ndarray:
    """SetSketch registers of each text's distinct shingles, one byte each; 0 for none.

    Register values fall as the exponential value grows, so the least hash decides.
    """
    least = np.full((count, rows), 0xFFFFFFFF, np.uint32)
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        owners = row[starts]
        low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
        for i in range(count):
            spread = (low ^ _SHIFTS[i]) * _FACTORS[i]
            spread ^= high
            spread *= _FACTORS_2[i]
            spread ^= spread >> np.uint32(15)
            least[i, owners] = np.minimum.reduceat(spread, starts)
    uniform = (least.astype(float) + 0.5) / 2.0**32
    exponential = -np.log1p(-uniform)
    level = np.floor(OFFSET - np.log(exponential) / np.log(BASE))
    return np.ascontiguousarray(np.clip(level, 0, 255).astype(np.uint8).T)


def set_sketches(docs: DataFrame, k: int, registers: int = REGISTERS) -> DataFrame:
    """Rows ``doc_id, n_shingles, key_a, key_b, registers``; equal keys mean equal sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in wordhash.slices(whole, 1):
                n = part.num_rows
                row, value = wordhash.distinct(
                    *wordhash.shingles(*wordhash.batch_bytes(part.column(1)), k)
                )
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(row):
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    a[row[starts]] = np.add.reduceat(value, starts)
                    b[row[starts]] = np.add.reduceat(wordhash.mixed(~value), starts)
                levels = registers_of(row, value, n, registers)
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.array([x.tobytes() for x in levels], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, SKETCH_SCHEMA)


def joint_similarity(
    first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray
) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    above = (first > second).sum(axis=1)[:, None]
    below = (first < second).sum(axis=1)[:, None]
    same = first.shape[1] - above - below
    u = (n_first / (n_first + n_second))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 81)[None, :] * most

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)

    up, down = chance(u - v * grid), chance(v - u * grid)
    level = np.maximum(1.0 - up - down, 1e-12)
    likelihood = (
        above * np.log(np.maximum(up, 1e-12))
        + below * np.log(np.maximum(down, 1e-12))
        + same * np.log(level)
    )
    return np.take_along_axis(grid, np.argmax(likelihood, axis=1)[:, None], axis=1)[:, 0]


def _slack(registers: int, percent: int) -> float:
    p = percent / 100.0
    return ERRORS * (p * (1.0 - p) / registers) ** 0.5


def plausible(first, second, n_first, n_second, percent: int = PERCENT) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose sketches do not speak against it.

    Registers are equal at least as often as the sets' similarity says, which settles
    most pairs before the likelihood is needed.
    """
    registers = first.shape[1]
    least = percent / 100.0 - _slack(registers, percent)
    low, high = np.minimum(n_first, n_second), np.maximum(n_first, n_second)
    out = 100 * low >= percent * high
    out[out] = (first[out] == second[out]).sum(axis=1) >= least * registers
    for part in np.array_split(np.flatnonzero(out), 1 + out.sum() // 4096):
        found = joint_similarity(first[part], second[part], n_first[part], n_second[part])
        out[part] = found >= least
    return out


def band_rows(classes: DataFrame) -> DataFrame:
    """Rows ``band, doc_id``: a hash of every band of each sketch."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = REGISTERS // ROWS
        for rows in batches:
            if rows.num_rows:
                levels = np.vstack(
                    [np.frombuffer(r, np.uint8) for r in rows.column(1).to_pylist()]
                ).reshape(rows.num_rows, count, ROWS)
                key = np.arange(count, dtype=np.uint64)[None, :] + np.uint64(1)
                for j in range(ROWS):
                    key = wordhash.mixed((key << np.uint64(8)) ^ levels[:, :, j])
                # The low bits name the band, so that a pair is reported by its first one only.
                key = key & ~BAND_BITS | np.arange(count, dtype=np.uint64)[None, :]
                ids = np.repeat(np.asarray(rows.column(0)), count)
                yield pa.record_batch(
                    [pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["band", "doc_id"]
                )

    return classes.select("doc_id", "registers").mapInArrow(bands, "band long, doc_id long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("doc_id").alias(name),
            F.col("registers").alias(f"r_{name}"),
            F.col("n_shingles").alias(f"n_{name}"),
        )

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                cols = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
                first, second = (
                    np.vstack([np.frombuffer(r, np.uint8) for r in cols[c].to_pylist()])
                    for c in ("r_a", "r_b")
                )
                good = plausible(
                    first, second, np.asarray(cols["n_a"]), np.asarray(cols["n_b"])
                )
                kept = rows.filter(pa.array(good))
                yield pa.record_batch(
                    [kept.column("a"), kept.column("b")], names=["a", "b"]
                )

    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "r_a", "r_b", "n_a", "n_b")
        .mapInArrow(sift, "a long, b long")
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in wordhash.slices(whole, 2):
                n = rows.num_rows
                row_a, in_a = wordhash.distinct(
                    *wordhash.shingles(*wordhash.batch_bytes(rows.column(2)), k)
                )
                row_b, in_b = wordhash.distinct(
                    *wordhash.shingles(*wordhash.batch_bytes(rows.column(3)), k)
                )
                # Equal (row, hash) stand next to each other once both are sorted together.
                row = np.concatenate([row_a, row_b])
                value = np.concatenate([in_a, in_b])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twin = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                both = np.bincount(row[1:][twin], minlength=n)
                union = np.bincount(row, minlength=n) - both
                good = pa.array(100 * both >= percent * union)
                kept = rows.filter(good)
                yield pa.record_batch([kept.column(0), kept.column(1)], names=["a", "b"])

    text_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    text_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(text_a, "a")
        .join(text_b, "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(compare, "a long, b long")
    )


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of members of one bucket that lie in different components.

    ``rows``: band, doc_id, component, n_shingles, registers, of buckets with several
    components. Buckets are cut into blocks of about ``BLOCK`` members, and blocks of
    the same bucket meet in pairs; many small buckets share a task.
    """
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")),
        lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")),
    )
    dealt = (
        rows.join(sizes, "band")
        .withColumn("mine", mine)
        .withColumn("cell", F.explode(others))
    )
    groups = max(1, dealt.count() // GROUP_ROWS)
    dealt = dealt.withColumn(
        "part", F.pmod(F.xxhash64("band", "cell.i", "cell.j"), F.lit(groups))
    ).select(
        "part", "band", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"),
        "mine", "doc_id", "component", "n_shingles", "registers",
    )

    def meet(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["band", "i", "j"], ignore_index=True)
        levels = np.vstack([np.frombuffer(r, np.uint8) for r in found["registers"]])
        rough = np.ascontiguousarray(levels[:, :REGISTERS])
        enough = (percent / 100.0 - _slack(REGISTERS, percent)) * REGISTERS
        ids, size = found["doc_id"].to_numpy(), found["n_shingles"].to_numpy()
        group, block = found["component"].to_numpy(), found["mine"].to_numpy()
        cells = found[["band", "i", "j"]].to_numpy()
        edge = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for start, stop in zip([0, *edge], [*edge, len(ids)]):
            within = cells[start, 1] == cells[start, 2]
            for p in range(start, stop - 1):
                rest = np.arange(p + 1, stop)
                wanted = group[p + 1 : stop] != group[p]
                if not within:
                    wanted &= block[p + 1 : stop] != block[p]
                rest = rest[wanted]
                close = 100 * np.minimum(size[rest], size[p]) >= percent * np.maximum(
                    size[rest], size[p]
                )
                rest = rest[close]
                rest = rest[(rough[rest] == rough[p]).sum(axis=1) >= enough]
                left.append(np.full(len(rest), p))
                right.append(rest)
        p, q = np.concatenate(left), np.concatenate(right)
        # A pair may share many buckets; that of its first common band reports it.
        slot = (cells[:, 0].astype(np.uint64) & BAND_BITS).astype(int)
        good = np.zeros(len(p), bool)
        for at in np.array_split(np.arange(len(p)), 1 + len(p) // 4096):
            equal = rough[p[at]] == rough[q[at]]
            same = equal.reshape(len(at), REGISTERS // ROWS, ROWS).all(axis=2)
            at = at[np.argmax(same, axis=1) == slot[p[at]]]
            good[at] = plausible(levels[p[at]], levels[q[at]], size[p[at]], size[q[at]], percent)
        pairs = np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])])
        return pd.DataFrame({"a": pairs[0][good], "b": pairs[1][good]})

    return dealt.groupBy("part").applyInPandas(meet, "a long, b long").distinct()


def near_components(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id``, one per document."""
    sketches = stored(set_sketches(docs, k), "sketches")
    key = ["key_a", "key_b", "n_shingles"]
    members = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(
        members.groupBy(*key).agg(
            F.min("doc_id").alias("doc_id"), F.any_value("registers").alias("registers")
        ),
        "set-classes",
    )
    bands = stored(band_rows(classes), "bands")
    # Stored before it is joined, so that a hot band's rows can be split.
    buckets = stored(
        bands.groupBy("band")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where(F.col("low") != F.col("high")),
        "buckets",
    )
    shared = stored(bands.join(buckets, "band"), "shared-bands")
    # Later rounds read only the texts of documents that share a band with another.
    wanted = shared.select("doc_id").distinct()
    texts = stored(docs.select("doc_id", "text").join(wanted, "doc_id").dropDuplicates(["doc_id"]), "band-texts")

    release(docs.sparkSession)

    def star(center: str) -> DataFrame:
        return (
            shared.where(F.col("doc_id") != F.col(center))
            .select(
                F.least("doc_id", center).alias("a"), F.greatest("doc_id", center).alias("b")
            )
            .distinct()
        )

    tried = stored(_likely(star("low").union(star("high")).distinct(), classes), "star-pairs")
    edges = stored(_confirmed(tried, texts, k, percent), "star-links")
    release(docs.sparkSession)
    groups = connected_components(edges)
    labelled = (
        shared.select("band", "doc_id")
        .join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    )
    mixed = labelled.groupBy("band").agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    ).where(F.col("x") != F.col("y")).select("band")
    open_rows = stored(labelled.join(mixed, "band"), "open-buckets")
    open_texts = texts.join(open_rows.select("doc_id").distinct(), "doc_id")
    fine = stored(set_sketches(open_texts, k, FINE_REGISTERS), "fine-sketches")
    release(docs.sparkSession)
    met = _cross_pairs(
        open_rows.join(fine.select("doc_id", "n_shingles", "registers"), "doc_id"), percent
    )
    rest = stored(met.join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    release(docs.sparkSession)
    more = stored(_confirmed(rest, texts, k, percent), "cross-links")
    release(docs.sparkSession)
    all_groups = connected_components(edges.unionByName(more))
    class_of = classes.select(*key, F.col("doc_id").alias("class_id"))
    group_of = all_groups.select(F.col("id").alias("class_id"), "component")
    return (
        sketches.select("doc_id", *key)
        .join(class_of, key, "left")
        .join(group_of, "class_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id")).alias("found"),
        )
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias(
                "component_id"
            ),
        )
    )


def _document_key() -> Column:
    """Tells documents apart by id and text; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``near_components`` with ``kept``: the smallest id of a component stays.

    Of different texts under one id each is linked by its own: the one with the smallest
    hash goes by the id, the others by a hash of id and text.
    """
    docs = docs.select("doc_id", "text").withColumn("own", F.xxhash64("text"))
    shared = stored(
        docs.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("own").alias("low"), F.max("own").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("doc_id", "low"),
        "shared-ids",
    )
    if shared.isEmpty():
        found = near_components(docs, k, percent)
    else:
        other = F.col("low").isNotNull() & (F.col("own") != F.col("low"))
        keyed = docs.join(shared, "doc_id", "left").withColumn(
            "key", F.when(other, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
        )
        names = stored(
            keyed.where(other).select("key", F.col("doc_id").alias("shared_id")).distinct(), "names"
        )
        parts = stored(
            near_components(keyed.select(F.col("key").alias("doc_id"), "text"), k, percent)
            .withColumnRenamed("doc_id", "key")
            .join(names, "key", "left")
            .withColumn("doc_id", F.coalesce("shared_id", "key")),
            "document-components",
        )
        least = parts.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        found = parts.join(stored(least, "least-ids"), "component_id", "left").select(
            "doc_id", "n_shingles", F.col("least").alias("component_id")
        )
    return found.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """Documents with one of each group of near copies, with all their columns.

    Documents are told apart by id and text: different texts under one id are compared
    like any others, of equal rows one stays. Of a group the smallest id stays, and of its
    texts that with the smallest hash. Rows without id all stay.
    """
    (key,) = fresh(docs, "document_key")
    known = docs.where(F.col("doc_id").isNotNull()).withColumn(key, _document_key())
    names = known.select("doc_id", F.col(key).alias("name")).distinct()
    groups = near_components(
        known.select(F.col(key).alias("doc_id"), "text"), k, percent
    ).select(F.col("doc_id").alias("name"), "component_id")
    members = stored(names.join(groups.distinct(), "name"), "near-copies")
    both = F.struct("doc_id", "name")
    first = (
        members.groupBy("component_id")
        .agg(F.min(both).alias("first"), F.max(both).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("component_id", F.col("first.name").alias("stays"))
    )
    (gone_key,) = fresh(known, "gone_key")
    gone = (
        members.join(first, "component_id")
        .where(F.col("name") != F.col("stays"))
        .select(F.col("name").alias(gone_key))
        .distinct()
    )
    left = known.join(gone, known[key] == gone[gone_key], "left_anti")
    return (
        left.dropDuplicates([key])
        .select(*docs.columns)
        .unionByName(docs.where(F.col("doc_id").isNull()))
    )
