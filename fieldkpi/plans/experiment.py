"""Before/after comparison of samples.

Samples are long rows: group keys, a ``period`` label, a ``metric`` name and a
``value``. Every test is a few grouped moments, then a closed form on one row
per group; samples never leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.joins import join_same
from fieldkpi.functions.labels import ratio
from fieldkpi.functions.quantiles import exact_quantiles, quantiles_of_counts, value_counts
from fieldkpi.functions.tails import chi2_upper_udf, f_upper_udf, t_two_sided_udf
from fieldkpi.functions.times import Day, day, shift_day

BEFORE, AFTER = "before", "after"


# --- shaping samples -------------------------------------------------------


def label_period(
    df: DataFrame, date: str, change_date: Day, boundary: str = AFTER
) -> DataFrame:
    """Add ``period``. The change day itself is ``boundary``: before, after or dropped
    (``"exclude"``)."""
    if boundary not in (BEFORE, AFTER, "exclude"):
        raise ValueError(f"unknown boundary {boundary!r}")
    when, change = F.col(date), day(change_date)
    if boundary == "exclude":
        df = df.where(when != change)
    before = when <= change if boundary == BEFORE else when < change
    return df.where(when.isNotNull()).withColumn(
        "period", F.when(before, BEFORE).otherwise(AFTER)
    )


def around(
    df: DataFrame, date: str, change_date: Day, days: int = 14, inclusive: bool = True
) -> DataFrame:
    """Rows within ``days`` of the change, with or without the two end days."""
    first, last = shift_day(change_date, -days), shift_day(change_date, days)
    if not inclusive:
        first, last = shift_day(first, 1), shift_day(last, -1)
    return df.where(F.col(date).between(day(first), day(last)))


def until(df: DataFrame, date: str, as_of: Day) -> DataFrame:
    """Rows of complete days: those before ``as_of``."""
    return df.where(F.col(date) < day(as_of))


def select_treatment(df: DataFrame, zone: str, treated: str) -> DataFrame:
    """All zones before the change, only the treated zone after it."""
    return df.where((F.col("period") == BEFORE) | (F.col(zone) == treated))


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric from one column per metric."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def daily_means(long: DataFrame, date: str, *keys: str) -> DataFrame:
    """One sample per day: the mean of the day's values."""
    return long.groupBy(*keys, date, "metric").agg(F.avg("value").alias("value"))


def pooled_samples(long: DataFrame, *keys: str) -> DataFrame:
    """All observations of a period together, whatever their day."""
    return long.select(*keys, "metric", "value").where(F.col("value").isNotNull())


# --- moments and tests -----------------------------------------------------


def _moments(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys, "period").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("var"),
        F.stddev_pop(value).alias("std"),
    )


def _spread(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_moments`` with the ``median`` of each period, and the mean ``m`` and variance ``v``
    of the distances to it.

    Everything comes from one count of equal values, so the samples are read once. The
    moments are sums of differences from the median, which is never further from the mean
    than one deviation, so no digits are lost.
    """
    by = [*keys, "period"]
    values = value_counts(long, by, "value")
    medians = quantiles_of_counts(values, by, [0.5]).select(
        *by, F.col("quantile").alias("median")
    )
    off = F.col("_v") - F.col("median")
    n = F.col("n")
    sums = (
        join_same(values, medians, by)
        .groupBy(*by, "median")
        .agg(
            F.sum("_c").alias("n"),
            F.sum(off * F.col("_c")).alias("_off"),
            F.sum(F.abs(off) * F.col("_c")).alias("_abs"),
            F.sum(off * off * F.col("_c")).alias("_squares"),
        )
    )
    shift, m, squares = F.col("_off") / n, F.col("_abs") / n, F.col("_squares") / n
    var_pop = F.greatest(squares - shift * shift, F.lit(0.0))
    return sums.select(
        *by,
        "n",
        (F.col("median") + shift).alias("mean"),
        "median",
        F.try_divide(n * var_pop, n - 1).alias("var"),
        F.sqrt(var_pop).alias("std"),
        m.alias("m"),
        F.greatest(squares - m * m, F.lit(0.0)).alias("v"),
    )


def _side_by_side(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    def of(period: str, name: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(name))).alias(f"{period}_{name}")

    return moments.groupBy(*keys).agg(
        *(of(p, name) for p in (BEFORE, AFTER) for name in ("n", "mean", "var", "std"))
    )


def describe_periods(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, exact median and population deviation of each period."""
    return _spread(long, (*keys, "metric")).select(
        *keys, "metric", "period", "n", "mean", "median", "std"
    )


def welch_t(long: DataFrame, *keys: str) -> DataFrame:
    """Means and the two-sample t test with unequal variances, before minus after."""
    keys = (*keys, "metric")
    return _welch(_side_by_side(_moments(long, keys), keys))


def _welch(pairs: DataFrame) -> DataFrame:
    a = F.try_divide("before_var", "before_n")
    b = F.try_divide("after_var", "after_n")
    degrees = F.try_divide(
        (a + b) * (a + b),
        F.try_divide(a * a, F.col("before_n") - 1) + F.try_divide(b * b, F.col("after_n") - 1),
    )
    score = F.try_divide(F.col("before_mean") - F.col("after_mean"), F.sqrt(a + b))
    scored = pairs.withColumn("t_score", score).withColumn("df", degrees)
    return scored.withColumn("p_value", t_two_sided_udf("t_score", "df"))


def levene(long: DataFrame, *keys: str) -> DataFrame:
    """Equality of spread across periods, from distances to the period median."""
    keys = (*keys, "metric")
    return _levene(_spread(long, keys), keys)


def _levene(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Between-period squares come from the deviation of period means, weighted.
    total = F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / total
    sums = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"),
        total.alias("_n"),
        F.collect_list(F.struct("n", "m")).alias("_periods"),
        grand.alias("_grand"),
        F.sum(F.col("n") * F.col("v")).alias("_within"),
    )
    between = F.aggregate(
        "_periods",
        F.lit(0.0),
        lambda acc, p: acc
        + p["n"] * (p["m"] - F.col("_grand")) * (p["m"] - F.col("_grand")),
    )
    df1, df2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    return sums.select(
        *keys,
        F.try_divide(df2 * between, df1 * F.col("_within")).alias("levene"),
        df1.alias("levene_df1"),
        df2.alias("levene_df2"),
    ).withColumn("levene_p", f_upper_udf("levene", "levene_df1", "levene_df2"))


def bartlett(long: DataFrame, *keys: str) -> DataFrame:
    """Equality of variances across periods under normality."""
    keys = (*keys, "metric")
    return _bartlett(_moments(long, keys), keys)


def _bartlett(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    free = F.col("n") - 1
    sums = moments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("n").alias("_n"),
        F.sum(free * F.col("var")).alias("_squares"),
        F.sum(free * F.ln("var")).alias("_logs"),
        F.sum(F.try_divide(F.lit(1.0), free)).alias("_inverse"),
        F.min("var").alias("_least"),
        F.min("n").alias("_fewest"),
    )
    k, dof = F.col("_k"), F.col("_n") - F.col("_k")
    scale = 1.0 + F.try_divide(
        F.col("_inverse") - F.try_divide(F.lit(1.0), dof), 3.0 * (k - 1)
    )
    stat = F.try_divide(dof * F.ln(F.try_divide(F.col("_squares"), dof)) - F.col("_logs"), scale)
    return (
        sums.select(
            *keys,
            F.when((F.col("_least") > 0) & (F.col("_fewest") > 1) & (k > 1), stat).alias("bartlett"),
            (k - 1).alias("bartlett_df"),
        )
        .withColumn("bartlett_p", chi2_upper_udf("bartlett", "bartlett_df"))
    )


# --- summaries -------------------------------------------------------------


def impact_summary(long: DataFrame, *keys: str) -> DataFrame:
    """Means, t score, p value and degrees of freedom per group and metric."""
    return welch_t(long, *keys).select(
        *keys, "metric", "before_mean", "after_mean", "t_score", "p_value", "df"
    )


def impact_summary_full(long: DataFrame, *keys: str) -> DataFrame:
    """``impact_summary`` with population deviations and the spread test."""
    by = (*keys, "metric")
    spread = _spread(long, by)
    means = _welch(_side_by_side(spread, by))
    return join_same(means, _levene(spread, by), by).select(
        *by,
        "before_mean",
        "after_mean",
        "t_score",
        F.col("p_value").alias("p_t"),
        "df",
        "before_std",
        "after_std",
        F.col("levene").alias("f_score"),
        F.col("levene_p").alias("p_f"),
    )


def variance_summary(long: DataFrame, *keys: str) -> DataFrame:
    """Bartlett and Levene side by side."""
    by = (*keys, "metric")
    spread = _spread(long, by)
    return join_same(_bartlett(spread, by), _levene(spread, by), by).select(
        *by, "bartlett", "bartlett_p", "levene", "levene_p"
    )


def unpivot_summary(wide: DataFrame, *keys: str) -> DataFrame:
    """From one row per group and statistic to one row per group and metric.

    ``wide`` has the keys, ``statistic`` (before, after, t_score, p_value, df) and a
    column per metric.
    """
    metrics = [c for c in wide.columns if c not in keys and c != "statistic"]
    names = ("before", "after", "t_score", "p_value", "df")
    return (
        wide.unpivot([*keys, "statistic"], metrics, "metric", "value")
        .groupBy(*keys, "metric")
        .agg(*(F.max(F.when(F.col("statistic") == s, F.col("value"))).alias(s) for s in names))
    )


def wide_summary(summary: DataFrame, metrics: Sequence[str], *keys: str) -> DataFrame:
    """``impact_summary`` with one row per statistic and one column per metric."""
    named = summary.withColumnsRenamed({"before_mean": "before", "after_mean": "after"})
    return (
        named.unpivot(
            [*keys, "metric"],
            ["before", "after", "t_score", "p_value", "df"],
            "statistic",
            "value",
        )
        .groupBy(*keys, "statistic")
        .agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))
    )


def improved(summary: DataFrame) -> DataFrame:
    """Rows whose metric fell after the change."""
    return summary.where(F.col("t_score") > 0)


# --- distributions ---------------------------------------------------------


def value_histogram(long: DataFrame, *keys: str, bins: int = 28) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, empty bins too.

    The last bin holds its upper edge; a group with one value is centred in a
    range of width one.
    """
    known = long.where(F.col("value").isNotNull()).select(*keys, "value")
    span = known.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    bucket = F.least(F.width_bucket("value", "lo", "hi", F.lit(bins)), F.lit(bins))
    counts = (
        join_same(known, span, keys)
        .groupBy(*keys, bucket.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    frame = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    by = [*keys, "bin"]
    renamed = counts.select(*(F.col(k).alias(f"_group_{k}") for k in by), "_c")
    same = [frame[k].eqNullSafe(renamed[f"_group_{k}"]) for k in by]
    return frame.join(renamed, same, "left").select(
        *by,
        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("lo") + F.col("bin") * width).alias("upper"),
        F.coalesce("_c", F.lit(0)).alias("n"),
    )


def distribution_summary(
    long: DataFrame, *keys: str, probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)
) -> DataFrame:
    """Exact quantiles of each group."""
    return exact_quantiles(long, keys, "value", probs)


def metric_series(long: DataFrame, date: str, *keys: str) -> DataFrame:
    """Daily mean of each metric in order of day."""
    return daily_means(long, date, *keys).orderBy(*keys, "metric", date)
