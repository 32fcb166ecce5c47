"""Mix sources to target weights by filling each source's budget with whole documents.

Documents are counted by exact length. A source first gives as many full passes as
fit its target. Of the rest, every length gives the same share, then long lengths
give one more each while they fit, and a bounded-knapsack dynamic programme over
the lengths left fills what remains. Documents of a length are chosen in the order
of a seeded hash.

What one task sees is a histogram: a source has at most about sqrt(2 * words)
distinct lengths, however many documents. A hot (source, length) is spread over
``BUCKETS`` hash ranges; only the range in which the choice ends is ranked.

Cases: a null text has size 0; documents of size 0 are never taken; a null source
is a source of its own, after all others; repeated rows are separate documents
(equal rows are interchangeable); an empty table gives an empty result; extra
columns are not read by ``mix_plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldkpi.llm.common import SPACES, fresh, stored, text_or_empty, travels

travels(__name__)

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
# Words the dynamic programme may be asked to fill; greedy steps come down to it.
KNAPSACK = 1 << 16
BUCKETS = 1 << 12


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    gaps = F.regexp_count(text, F.lit(rf"(?:^|[{SPACES}])[^{SPACES}]"))
    return F.coalesce(gaps, F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], limit: float) -> list[float]:
    """Shares of the total by weight, none above ``limit`` times its size; excess is reshared."""
    left, targets = float(sum(sizes)), [0.0] * len(sizes)
    active = [i for i, n in enumerate(sizes) if n > 0]
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] > limit * sizes[i]]
        for i in full or active:
            targets[i] = float(limit * sizes[i]) if full else unit * weights[i]
            left -= targets[i]
        active = [i for i in active if i not in full] if full else []
    return targets


def fill_budget(
    lengths: Sequence[int], counts: Sequence[int], budget: int, cap: int = KNAPSACK
) -> list[int]:
    """How many documents of each length to take, so that their words come near ``budget``.

    ``lengths`` are distinct and positive. The sum never exceeds the budget. All lengths are
    taken in proportion first and the programme fills the rest; while that leaves words
    over, more of the documents taken are given back to it. With all given back, a budget of
    at most ``cap`` words is met as nearly as any choice from below could.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    even = [c * budget // total for c in counts]
    best, most = [0] * len(lengths), -1
    for give in (0, 1, 4, 16, max(even)):
        take = _fill_rest(lengths, counts, [t - min(t, give) for t in even], budget, cap)
        words = sum(n * t for n, t in zip(lengths, take))
        if words > most:
            best, most = take, words
        if words == budget:
            break
    return best


def _fill_rest(
    lengths: Sequence[int], counts: Sequence[int], take: list[int], budget: int, cap: int
) -> list[int]:
    """``take`` with more documents for what the budget leaves: the longest first until at
    most ``cap`` words are left, these by the bounded knapsack."""
    left = budget - sum(n * k for n, k in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= cap:
            break
        more = min(counts[i] - take[i], (left - cap) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    # Reachable sums as bits of one integer; multiplicities by halving.
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        spare = min(counts[i] - take[i], left // lengths[i])
        size = 1
        while spare > 0 and not reach >> left & 1:
            k = min(size, spare)
            wider = (reach | reach << k * lengths[i]) & mask
            if wider != reach:
                steps.append((i, k, reach))
                reach = wider
            spare, size = spare - k, size * 2
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def _source_order() -> Column:
    """Code-point order with null last: Spark compares strings by their UTF-8 bytes."""
    return F.col("source").asc_nulls_last()


def source_targets(
    histogram: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT
) -> DataFrame:
    """Rows ``source, source_size, target``; one row per source meets in one task."""
    totals = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")
    )

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["source"]
        order = sorted(
            range(len(rows)),
            key=lambda i: (pd.isna(names[i]), "" if pd.isna(names[i]) else names[i]),
        )
        rows = rows.iloc[order].reset_index(drop=True)
        each = [weights[i % len(weights)] for i in range(len(rows))]
        sizes = [int(n) for n in rows["source_size"]]
        return rows.assign(target=water_fill(sizes, each, limit))[
            ["source", "source_size", "target"]
        ]

    return (
        totals.withColumn("all", F.lit(1))
        .groupBy("all")
        .applyInPandas(fill, "source string, source_size long, target double")
    )


def length_choice(histogram: DataFrame, targets: DataFrame, cap: int = KNAPSACK) -> DataFrame:
    """Rows ``source, size, passes, extra``: full passes, and how many documents go once more."""
    planned = histogram.where(F.col("size") > 0).join(
        targets, histogram["source"].eqNullSafe(targets["source"])
    ).select(histogram["source"], "size", "n", "source_size", "target")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // size)
        rows = rows.sort_values("size", ignore_index=True)
        extra = fill_budget(
            [int(v) for v in rows["size"]],
            [int(v) for v in rows["n"]],
            round(target - passes * size),
            cap,
        )
        return rows.assign(passes=passes, extra=extra)[["source", "size", "passes", "extra"]]

    return planned.groupBy("source").applyInPandas(
        choose, "source string, size long, passes long, extra long"
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = 17,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows ``doc_id, size, source_size, target, taken`` and the ``keep`` columns.

    The texts are read once, to be counted; only ids, sources and sizes are shuffled.
    """
    # The text takes part, so that rows without id are spread over the ranges too.
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            word_count(text_or_empty()).alias("size"),
            draw.alias("draw"),
            *keep,
        ),
        "mix-sizes",
    )
    part = F.floor(F.col("draw") / ((1 << 40) // BUCKETS))
    cells = stored(
        sized.groupBy("source", "size", part.alias("part")).agg(F.count(F.lit(1)).alias("n")),
        "mix-cells",
    )
    histogram = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = stored(source_targets(histogram, weights, limit), "mix-targets")
    choice = stored(length_choice(histogram, targets), "mix-choice")

    # Of each length, whole hash ranges go until the one in which the choice ends.
    c = choice.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "passes", "extra"
    )
    of_choice = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    upto = Window.partitionBy("source", "size").orderBy("part")
    bounds = (
        cells.join(c, of_choice)
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("left", F.col("extra") - (F.col("upto") - F.col("n")))
        .where((F.col("left") >= 0) & (F.col("left") < F.col("n")))
        .select("_s", "_z", F.col("part").alias("last_part"), F.col("left").alias("last_n"))
    )
    # The last range may be missing where a length goes whole.
    rule = (
        c.join(
            bounds.select(F.col("_s").alias("_bs"), F.col("_z").alias("_bz"), "last_part", "last_n"),
            F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_z") == F.col("_bz")),
            "left",
        )
        .select(
            "_s",
            "_z",
            "passes",
            F.coalesce("last_part", F.lit(BUCKETS)).alias("last_part"),
            F.coalesce("last_n", F.lit(0)).alias("last_n"),
        )
    )
    marked = sized.withColumn("part", part).join(rule, of_choice, "left")
    edge = F.col("part") == F.col("last_part")
    rank = F.row_number().over(
        Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id", *keep)
    )
    ranked = marked.where(edge).withColumn(
        "more", (rank <= F.col("last_n")).cast("long")
    )
    clear = marked.where(~F.coalesce(edge, F.lit(False))).withColumn(
        "more", F.coalesce((F.col("part") < F.col("last_part")).cast("long"), F.lit(0))
    )
    t = targets.select(F.col("source").alias("_t"), "source_size", "target")
    return (
        ranked.unionByName(clear)
        .join(t, F.col("source").eqNullSafe(F.col("_t")), "left")
        .select(
            "doc_id",
            F.col("size"),
            "source_size",
            "target",
            (F.col("size") * (F.coalesce("passes", F.lit(0)) + F.col("more")))
            .cast("long")
            .alias("taken"),
            *keep,
        )
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with its own columns.

    Rows that share an id are told apart by source and text; equal rows are taken together
    as often as the plan takes them in all.
    """
    own = F.xxhash64("source", "text")
    twin, same_id, same_twin, times, copy = fresh(docs, "twin", "same_id", "same_twin", "times", "copy")
    planned = docs.select("doc_id", "source", "text", own.alias(twin))
    plan = (
        mix_plan(planned, seed=seed, keep=[twin])
        .where(F.col("taken") > 0)
        .groupBy(F.col("doc_id").alias(same_id), F.col(twin).alias(same_twin))
        .agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias(times))
    )
    joined = docs.withColumn(twin, own).join(
        plan, F.col("doc_id").eqNullSafe(F.col(same_id)) & (F.col(twin) == F.col(same_twin))
    )
    return (
        joined.dropDuplicates([same_id, same_twin])
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*docs.columns)
    )
