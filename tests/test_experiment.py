from __future__ import annotations

import math

import numpy as np
import pytest

from fieldkpi.functions import tails
from fieldkpi.functions.quantiles import exact_quantiles
from fieldkpi.plans import experiment
from tests.frames import rows, settings_of, table

import pandas as pd

# Published results of a change in pickup rules, one row per market and
# metric. market, metric, n before, n after, mean before, mean after, t, p, df,
# population deviation before, after, spread score, its p.
PUBLISHED = """
2-NY vtt 28 40 31.0686904765 24.658520834 2.05242034246 0.0445339938028 59.5220232038 12.2663057873 12.770762107 8.62128280181e-05 0.992619688703
2-NY ttt 28 40 46.4739564914 32.9264572753 3.2661297455 0.00185943975944 56.2752995104 16.8813204331 16.1044602009 0.249479579892 0.619102791091
6-DAL vtt 34 15 28.3730882374 41.5112777776 -4.26912430751 0.000353429960675 20.6227989034 7.60234204634 10.3958608255 3.44806921124 0.0695989439865
5-CHI vtt 27 20 32.2770679012 38.4470416667 -1.24094921907 0.223812453137 31.4129507328 12.7505660536 18.7319180487 2.72294017892 0.105879467041
1-BAY vtt 39 37 35.1091453012 34.333671174 0.176491982884 0.86040214063 72.1178899907 17.8181358411 19.8551654291 0.000141102123349 0.990554405042
7-HOU vtt 24 23 32.6705208373 32.2138405817 0.111259993216 0.911953499555 40.967532012 11.7168618153 15.4705655669 0.935612829485 0.338578712303
9-MIA vtt 22 17 30.2306439405 38.3582843166 -1.72447217446 0.0963075121626 26.4156806987 10.8845816741 16.2834168583 0.367977074364 0.547813307771
8-ATL vtt 14 11 34.7525595262 36.9361363631 -0.478801987426 0.636736080236 22.3230770823 11.3789763305 10.4106112051 0.00149543042216 0.969486563355
4-LA vtt 29 38 32.5320977018 35.4782017544 -0.668481126564 0.50636066939 60.7023100924 17.4908229671 17.7310573677 0.199418939219 0.656674551371
"""
# t, p, df of the zone test.
ZONE_TEST = """
4.04662928556 7.065705444e-05 233.629457051
-4.63754235227 6.91944441902e-06 173.281381529
-0.125921866581 0.899963005761 149.457126212
8.92893258181 1.00012177391e-16 247.321463452
10.1628553981 1.6468222985e-20 247.982845821
"""


def published():
    for line in PUBLISHED.strip().splitlines():
        market, metric, *numbers = line.split()
        yield market, metric, *map(float, numbers)


def with_moments(n: int, mean: float, std: float) -> np.ndarray:
    z = np.arange(n, dtype=float) ** 1.5
    return mean + std * (z - z.mean()) / z.std()


def samples(spark, groups: dict) -> object:
    """Long rows from {(market, period, metric): values}."""
    return table(
        spark,
        "samples",
        [(*key, None if v is None else float(v)) for key, vals in groups.items() for v in vals],
    )


def test_published_means_and_t_tests(spark):
    groups, expected = {}, {}
    for market, metric, n1, n2, m1, m2, t, p, df, s1, s2, *_ in published():
        groups[market, "before", metric] = with_moments(int(n1), m1, s1)
        groups[market, "after", metric] = with_moments(int(n2), m2, s2)
        expected[market, metric] = (m1, m2, t, p, df, s1, s2)
    found = experiment.impact_summary_full(samples(spark, groups), "market").collect()
    assert len(found) == len(expected)
    for r in found:
        ours = (r.before_mean, r.after_mean, r.t_score, r.p_t, r.df, r.before_std, r.after_std)
        assert ours == pytest.approx(expected[r.market, r.metric], rel=1e-8)


def test_published_tails():
    for market, _, n1, n2, _, _, t, p, df, _, _, f, p_f in published():
        assert tails.t_two_sided(pd.Series([t]), pd.Series([df]))[0] == pytest.approx(p, rel=1e-9)
        two = tails.f_upper(pd.Series([f]), pd.Series([1.0]), pd.Series([n1 + n2 - 2]))
        assert two[0] == pytest.approx(p_f, rel=1e-9)
    for line in ZONE_TEST.strip().splitlines():
        t, p, df = map(float, line.split())
        assert tails.t_two_sided(pd.Series([t]), pd.Series([df]))[0] == pytest.approx(p, rel=1e-9)


def test_tails_known_values_and_limits():
    # One degree of freedom: Cauchy. Many: normal. Chi-square with 2: exponential.
    assert tails.t_two_sided(pd.Series([1.0]), pd.Series([1.0]))[0] == pytest.approx(0.5)
    normal = math.erfc(1.96 / math.sqrt(2))
    for df in (1e8, 1e12):
        assert tails.t_two_sided(pd.Series([1.96]), pd.Series([df]))[0] == pytest.approx(
            normal, rel=1e-6
        )
    x = pd.Series([0.0, 0.5, 3.0, 40.0])
    assert np.allclose(tails.chi2_upper(x, pd.Series([2.0] * 4)), np.exp(-x / 2), rtol=1e-12)
    assert pd.isna(tails.t_two_sided(pd.Series([None], dtype=float), pd.Series([3.0]))[0])
    assert pd.isna(tails.f_upper(pd.Series([1.0]), pd.Series([0.0]), pd.Series([3.0]))[0])


@pytest.mark.parametrize("df", [1e3, 1e4, 1e5, 1e6, 1e7])
def test_tails_at_many_degrees_of_freedom(df):
    f = pd.Series([0.1, 0.9, 1.0, 3.0, 12.0])
    many, two = pd.Series([df] * 5), pd.Series([2.0] * 5)
    # Two degrees of freedom have closed forms on either side.
    closed = np.exp(-df / 2 * np.log1p(2 * f / df))
    assert np.allclose(tails.f_upper(f, two, many), closed, rtol=1e-8, atol=0)
    below = np.exp(-df / 2 * np.log1p(2 / (df * f)))
    assert np.allclose(1 - tails.f_upper(f, many, two), below, rtol=1e-8, atol=0)
    # Chi-square at its mean and a half: sums of Poisson chances, by their logs.
    for x in (df, 0.99 * df, 1.01 * df) if df <= 1e5 else ():
        k = np.arange(int(df / 2))
        terms = k * math.log(x / 2) - x / 2 - np.concatenate(
            [[0.0], np.cumsum(np.log(np.arange(1, len(k))))]
        )
        found = tails.chi2_upper(pd.Series([x]), pd.Series([df]))[0]
        assert found == pytest.approx(math.fsum(np.exp(terms)), rel=1e-7)
    near = 0.5 - 1 / (3 * math.sqrt(2 * math.pi * df / 2))
    at_mean = tails.chi2_upper(pd.Series([df]), pd.Series([df]))[0]
    assert at_mean == pytest.approx(near, abs=0.01 / df)


def test_unknown_boundary_is_refused(spark):
    days = spark.createDataFrame([("2020-01-01",)], "day string")
    with pytest.raises(ValueError):
        experiment.label_period(days, "day", "2020-01-01", "befor")


def test_levene_and_bartlett_by_hand(spark):
    rng = np.random.default_rng(7)
    a, b = rng.gamma(2, 10, 41), rng.gamma(2, 20, 60)
    long = samples(spark, {("m", "before", "x"): a, ("m", "after", "x"): b})
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    z = np.concatenate([za, zb])
    between = len(a) * (za.mean() - z.mean()) ** 2 + len(b) * (zb.mean() - z.mean()) ** 2
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    w = (len(z) - 2) * between / within
    va, vb = a.var(ddof=1), b.var(ddof=1)
    pooled = ((len(a) - 1) * va + (len(b) - 1) * vb) / (len(z) - 2)
    t = (len(z) - 2) * np.log(pooled) - (len(a) - 1) * np.log(va) - (len(b) - 1) * np.log(vb)
    t /= 1 + (1 / (len(a) - 1) + 1 / (len(b) - 1) - 1 / (len(z) - 2)) / 3
    found = experiment.variance_summary(long, "market").first()
    assert (found.levene, found.bartlett) == pytest.approx((w, t), rel=1e-10)
    assert found.bartlett_p == pytest.approx(math.erfc(math.sqrt(t / 2)), rel=1e-9)


def test_small_and_flat_groups_have_no_scores(spark):
    long = samples(
        spark,
        {
            ("single", "before", "x"): [1.0],
            ("single", "after", "x"): [1.0, 2.0],
            ("flat", "before", "x"): [1.0, 1.0],
            ("flat", "after", "x"): [1.0, 1.0],
            ("once", "before", "x"): [1.0, 2.0, None],
            (None, "before", "x"): [1.0, 2.0, 4.0],
            (None, "after", "x"): [2.0, 3.0, 5.0],
        },
    )
    scores = {r[0]: r[1:] for r in rows(experiment.welch_t(long, "market"), "market", "t_score", "df", "p_value")}
    assert scores["single"] == scores["flat"] == scores["once"] == (None, None, None)
    assert scores[None][0] is not None
    spread = {r[0]: r[1:] for r in rows(experiment.variance_summary(long, "market"), "market", "bartlett", "levene")}
    assert spread["single"][0] is None and spread["flat"] == (None, None)
    assert spread["once"] == (None, None) and None not in spread[None]


def test_period_boundary_and_windows(spark):
    days = table(
        spark, "d date, zone string, v int",
        [("2016-11-03", "LA-A", 1), ("2016-11-04", "LA-A", 2), ("2016-11-18", "LA-B", 3),
         ("2016-12-02", "LA-B", 4), ("2016-12-03", "LA-A", 5), (None, "LA-A", 6)],
    )
    change = "2016-11-18"

    def split(boundary):
        found = experiment.label_period(days, "d", change, boundary)
        return [p for _, p in sorted(rows(found, "v", "period"))]

    b, a = "before", "after"
    assert split("after") == [b, b, a, a, a]
    assert split("before") == [b, b, b, a, a]
    assert split("exclude") == [b, b, a, a]
    around = experiment.around(days, "d", change)
    assert rows(around, "v") == [(2,), (3,), (4,)]
    assert rows(experiment.around(days, "d", change, inclusive=False), "v") == [(3,)]
    assert rows(experiment.until(days, "d", "2016-12-02"), "v") == [(1,), (2,), (3,)]
    treated = experiment.select_treatment(
        experiment.label_period(days, "d", change), "zone", "LA-A"
    )
    assert rows(treated, "v") == [(1,), (2,), (5,)]


def test_daily_means_weigh_days_equally(spark):
    long = table(
        spark, "d date, period string, metric string, value double",
        [("2016-11-01", "before", "x", 1.0), ("2016-11-01", "before", "x", 3.0),
         ("2016-11-02", "before", "x", 10.0), ("2016-11-02", "before", "x", None)],
    )
    daily = experiment.daily_means(long, "d", "period")
    assert rows(daily, "d", "value") == [("2016-11-01", 2.0), ("2016-11-02", 10.0)]
    assert experiment.pooled_samples(long, "period").count() == 3
    assert rows(experiment.describe_periods(daily), "n", "mean", "median", "std") == [
        (2, 6.0, 6.0, 4.0)
    ]
    assert [r.value for r in experiment.metric_series(long, "d").collect()] == [2.0, 10.0]


def test_summary_reshaping(spark):
    long = samples(
        spark,
        {
            ("a", "before", "vtt"): [5, 6, 7], ("a", "after", "vtt"): [1, 2, 4],
            ("a", "before", "ttt"): [1, 2, 4], ("a", "after", "ttt"): [5, 6, 7],
        },
    )
    summary = experiment.impact_summary(long, "market")
    assert rows(experiment.improved(summary), "metric") == [("vtt",)]
    wide = experiment.wide_summary(summary, ["vtt", "ttt"], "market")
    assert wide.columns == ["market", "statistic", "vtt", "ttt"]
    back = experiment.unpivot_summary(wide, "market")
    names = ("market", "metric", "before", "after", "t_score", "p_value", "df")
    assert tuple(back.columns) == names
    assert rows(back, *names) == rows(
        summary.withColumnsRenamed({"before_mean": "before", "after_mean": "after"}), *names
    )


def test_histogram_has_empty_bins_and_keeps_the_top_edge(spark):
    values = [0.0, 1.0, 1.5, 10.0, 10.0]
    long = samples(spark, {("a", "before", "x"): values, ("b", "before", "x"): [3.0, 3.0]})
    found = experiment.value_histogram(long, "market", bins=5).orderBy("market", "bin").collect()
    assert [r.n for r in found if r.market == "a"] == list(np.histogram(values, 5)[0])
    assert [r.n for r in found if r.market == "b"] == list(np.histogram([3.0, 3.0], 5)[0])


QUANTILES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize(
    "kind", ["spread", "repeated", "heavy_tail", "negative", "tiny"]
)
def test_exact_quantiles_against_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    values = {
        "spread": rng.normal(0, 1, 20_000),
        # A third of the rows share one value.
        "repeated": np.concatenate([np.full(5_000, 3.0), rng.integers(0, 9, 10_000)]),
        "heavy_tail": rng.pareto(0.7, 15_000) * 1e6,
        "negative": -rng.exponential(5, 9_999),
        "tiny": np.array([2.0, 1.0]),
    }[kind]
    long = samples(spark, {("g", "before", "x"): values, (None, "before", "x"): [4.0, None]})
    found = exact_quantiles(long, ["market", "metric"], "value", QUANTILES).collect()
    ours = {r.prob: r.quantile for r in found if r.market == "g"}
    assert [ours[p] for p in QUANTILES] == pytest.approx(
        list(np.quantile(values, QUANTILES)), rel=1e-12
    )
    assert {r.quantile for r in found if r.market is None} == {4.0}
    assert {r.n for r in found if r.market == "g"} == {len(values)}


def test_a_group_over_many_ranges_is_exact(spark):
    """Every range of a group holds few values; ranks on both sides of a cut are found."""
    values = np.random.default_rng(3).normal(0, 1, 3_001)
    long = samples(spark, {("g", "before", "x"): values, ("h", "before", "x"): values[:40]})
    settings = {
        "spark.sql.shuffle.partitions": "50",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    probs = [i / 37 for i in range(38)]
    with settings_of(spark, settings):
        found = exact_quantiles(long, ["market"], "value", probs).collect()
    assert len(found) == 2 * len(probs)
    for name, whole in (("g", values), ("h", values[:40])):
        ours = {r.prob: r.quantile for r in found if r.market == name}
        assert [ours[p] for p in probs] == pytest.approx(list(np.quantile(whole, probs)), rel=1e-12)


def test_quantiles_without_keys(spark):
    long = samples(spark, {("g", "before", "x"): range(101)})
    assert rows(exact_quantiles(long, [], "value", [0.5]), "quantile") == [(50.0,)]
