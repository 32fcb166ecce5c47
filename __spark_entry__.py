"""Registered queries over the star-schema tables, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkpi.functions.labels import CART_PARTNER, PICKUP_EVENT, TRAVEL_EVENT, partner_label
from fieldkpi.functions.times import shift_day
from fieldkpi.operators import (
    levels,
    located,
    orders,
    ped_views,
    pickups,
    reschedules,
    travel,
    units,
)
from fieldkpi.plans import deck, experiment
from fieldkpi.session import configure
from fieldkpi.sources import tables
from fieldkpi.sources.star_roles import AS_OF, CHANGE_DATE, StarRoles
from oracle.queries import ORACLE

# The corpus operators are optional: without their folder, or a library that only they
# need, the rest still works.
_CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CORPUS_ORACLE: dict[str, str] = {}
try:
    import corpus_pipeline
    from fieldkpi.llm.oracle import ORACLE as _CORPUS_SQL
    from fieldkpi.llm.queries import QUERIES as _CORPUS
except ImportError:
    pass
else:
    _CORPUS_QUERIES = _CORPUS | {"pipeline": corpus_pipeline.run}
    _CORPUS_ORACLE = _CORPUS_SQL

# Zones and product list of the zone and product restricted travel samples.
SAMPLE_SKUS = [str(n) for n in range(0, 200)]
# Rows of one array of samples.
CHUNK = 100


# --- shared inputs ---------------------------------------------------------


def _events(s: StarRoles, event_type: str = PICKUP_EVENT) -> DataFrame:
    return located.located_events(
        s.blocks_of(event_type), *s.get("sched", "experts", "centers"), event_type
    )


def _units(s: StarRoles) -> DataFrame:
    return pickups.units_per_transfer(*s.get("transfers", "bridge"))


def _partner_units(s: StarRoles, exclude_canceled: bool = False) -> DataFrame:
    return pickups.partner_units(
        *s.get("order_master", "items", "bridge"), exclude_canceled=exclude_canceled
    )


def _travel_tables(s: StarRoles) -> list[DataFrame]:
    """The inputs of the travel reports, which use the blocks of trips only."""
    return [
        *s.get("visits", "items", "bridge", "transfers"),
        s.blocks_of(TRAVEL_EVENT),
        *s.get("sched", "experts", "centers"),
    ]


def _travel_rows(s: StarRoles, **options) -> DataFrame:
    return travel.visit_travel_rows(*_travel_tables(s), **options)


def _zone_rows(s: StarRoles, **options) -> DataFrame:
    return _travel_rows(s, zones=s["zip_zones"], addresses=s["addresses"], **options)


def _history(s: StarRoles) -> DataFrame:
    return reschedules.order_reschedules(
        *s.get("visit_facts", "order_master", "experts", "centers")
    )


def _pickup_trips(s: StarRoles) -> DataFrame:
    return travel.pickup_travel_hours(s.blocks_of(TRAVEL_EVENT), *s.get("sched", "transfers"))


def _samples(s: StarRoles) -> DataFrame:
    """Event values as samples: metric is the event type, arm the zone of the user."""
    return s.table("events").select(
        F.col("event_type").alias("metric"),
        "value",
        F.when(F.col("user_id") % 2 == 0, "LA-A").otherwise("LA-B").alias("zone"),
        F.to_date("ts").alias("day"),
    )


def _market_samples(s: StarRoles) -> DataFrame:
    rows = s.table("events").select(
        F.col("user_id").alias("expert_id"),
        F.col("event_type").alias("metric"),
        "value",
        F.to_date("ts").alias("day"),
    )
    return located.at_home(rows, *s.get("experts", "centers"))


def _periods(df: DataFrame, boundary: str = "after") -> DataFrame:
    return experiment.label_period(df, "day", CHANGE_DATE, boundary)


def _daily_travel(s: StarRoles) -> DataFrame:
    """Daily mean travel per market, as before/after samples."""
    long = experiment.long_metrics(
        _travel_rows(s), ["visit_date", "market"], travel.TRAVEL_METRICS
    )
    daily = experiment.daily_means(long, "visit_date", "market")
    return experiment.label_period(daily, "visit_date", CHANGE_DATE)


_STATS = [f"{k}_{m}" for m in travel.TRAVEL_METRICS for k in ("min", "max", "avg", "std")]
_KPIS = [
    "visit_travel_time",
    "pickup_travel_time",
    "pickup_travel_time_per_visit",
    "avg_total_travel_time",
]


def _daily_stats(s: StarRoles) -> DataFrame:
    """The 16 daily statistics of each market as samples, without the change day."""
    stats = travel.travel_stats(_travel_rows(s), "visit_date", "market")
    complete = experiment.until(tables.fill_nulls(stats, 0.0, _STATS), "visit_date", AS_OF)
    long = experiment.long_metrics(complete, ["visit_date", "market"], _STATS)
    return experiment.label_period(long, "visit_date", CHANGE_DATE, "exclude")


def _daily_kpis(s: StarRoles, two_weeks: bool) -> DataFrame:
    """The daily travel metrics of each market as samples, without the change day."""
    around = (shift_day(CHANGE_DATE, -10), shift_day(CHANGE_DATE, 10))
    daily = travel.travel_metrics(*_travel_tables(s), between=around if two_weeks else None)
    if two_weeks:
        daily = experiment.around(daily, "visit_date", CHANGE_DATE, days=10, inclusive=False)
    long = experiment.long_metrics(daily, ["visit_date", "market"], _KPIS)
    return experiment.label_period(long, "visit_date", CHANGE_DATE, "exclude")


def _zone_samples(s: StarRoles) -> DataFrame:
    """Travel of all zones before the change and of the treated zone after it."""
    long = travel.travel_samples(_zone_rows(s), "zone", "visit_date")
    labelled = experiment.label_period(long, "visit_date", CHANGE_DATE)
    return experiment.select_treatment(labelled, "zone", "LA-A")


def _six(value: Column | str) -> Column:
    """Six places, by way of ten so that noise in the last bits cannot decide a tie."""
    return F.round(F.round(value, 10), 6)


def _joined_list(column: str) -> Column:
    """Array of doubles as sorted text in millionths, to compare across engines."""
    whole = F.transform(
        F.array_sort(column), lambda v: F.round(_six(v) * 1e6).cast("bigint").cast("string")
    )
    return F.array_join(whole, ",").alias(column)


def _as_text(arrays: DataFrame, *keys: str) -> DataFrame:
    return arrays.select(*keys, *(_joined_list(m) for m in travel.TRAVEL_METRICS))


# --- the deck --------------------------------------------------------------


def _roster(s: StarRoles) -> DataFrame:
    return deck.roster_days(
        *s.get("shifts", "experts", "profile_changes", "centers"), as_of=AS_OF
    )


def _headcount(s: StarRoles) -> DataFrame:
    return deck.skilled_headcount(_roster(s), *s.get("expert_badges", "badges"))


def _planned(s: StarRoles) -> DataFrame:
    return deck.planned_headcount(*s.get("fiscal_dates", "planned"), as_of=AS_OF)


def _used_hours(s: StarRoles) -> DataFrame:
    return deck.used_hours(
        *s.get("shifts", "sched", "blocks", "experts", "centers"), as_of=AS_OF
    )


def _shift_lengths(s: StarRoles) -> DataFrame:
    return deck.shift_length_histogram(
        *s.get("shifts", "experts", "centers"), _roster(s), as_of=AS_OF
    )


def _deck_pickups(s: StarRoles) -> DataFrame:
    return deck.pickup_totals(_events(s), _units(s), as_of=AS_OF)


def _deck(s: StarRoles) -> DataFrame:
    return deck.metrics_deck(
        _headcount(s),
        _planned(s),
        _used_hours(s),
        _shift_lengths(s),
        deck.visit_counts(s["order_master"], AS_OF),
        deck.booking_counts(s["order_master"], AS_OF),
        deck.travel_avgs(s["travel_times"], AS_OF),
        _deck_pickups(s),
        *s.get("centers", "fiscal_dates"),
    )


# --- registry --------------------------------------------------------------

_PLACE = ("experts", "centers")

_QUERIES: dict[str, Callable[[StarRoles], DataFrame]] = {
    # Pickups
    "located_events": lambda s: _events(s),
    "ped": lambda s: pickups.ped(_events(s)),
    "ped_check": lambda s: pickups.ped_check(_events(s), s["transfers"]),
    "ped_upp_components": lambda s: pickups.ped_upp_components(
        _events(s), *s.get("transfers", "bridge")
    ),
    "partner_ped": lambda s: pickups.partner_ped(_events(s), s["transfers"], _partner_units(s)),
    "partner_upp": lambda s: pickups.partner_upp(
        _events(s), s["transfers"], _partner_units(s, exclude_canceled=True)
    ),
    "partner_components": lambda s: pickups.partner_components(
        _events(s), s["transfers"], _partner_units(s)
    ),
    "upp": lambda s: pickups.upp(_events(s), _units(s)),
    "travel_to_pickup": lambda s: pickups.travel_to_pickup(
        _events(s, TRAVEL_EVENT), s["transfers"]
    ),
    "pickup_duration": lambda s: pickups.pickup_duration(_events(s)),
    "pickup_duration_per_unit": lambda s: pickups.pickup_duration_per_unit(_events(s), _units(s)),
    "pickup_units_histogram": lambda s: pickups.pickup_units_histogram(_units(s)),
    "pickup_class_mix": lambda s: pickups.pickup_class_mix(_events(s), _units(s)),
    "ped_levels": lambda s: levels.ped_levels(_events(s)),
    "upp_levels": lambda s: levels.upp_levels(_events(s), _units(s)),
    "partner_rate_levels": lambda s: levels.rates_within(
        _events(s), levels.carried_by_partner(*s.get("order_master", "items", "bridge")), "partner"
    ),
    "location_rate_levels": lambda s: levels.rates_within(
        _events(s),
        levels.carried_by_location(s["transfers"], _units(s), s["locations"]),
        "location",
    ),
    "distinct_expert_levels": lambda s: levels.distinct_levels(
        levels.daily_bitmaps(_events(s)), "n_experts"
    ),
    # Pickup rates by location, product, week, region, expert
    "ped_by_location": lambda s: ped_views.ped_by_location(*s.get("locations", "transfers")),
    "ped_by_sku": lambda s: ped_views.ped_by_sku(
        *s.get("transfers", "bridge", "items", "products")
    ),
    "ped_by_week": lambda s: ped_views.ped_by_week(
        *s.get("transfers", "fiscal_dates", "experts")
    ),
    "ped_by_week_of_pickups": lambda s: ped_views.ped_by_week(
        *s.get("pickups", "fiscal_dates", "experts")
    ),
    "ped_by_region": lambda s: ped_views.ped_by_region(*s.get("transfers", "experts")),
    "ped_by_region_of_pickups": lambda s: ped_views.ped_by_region(*s.get("pickups", "experts")),
    "ped_by_expert": lambda s: ped_views.ped_by_expert(*s.get("transfers", "experts")),
    "ped_by_expert_of_pickups": lambda s: ped_views.ped_by_expert(*s.get("pickups", "experts")),
    "ped_overall": lambda s: ped_views.ped_overall(s["transfers"]),
    "ped_overall_of_roster": lambda s: ped_views.ped_overall(*s.get("pickups", "roster")),
    "entity_counts": lambda s: ped_views.entity_counts(*s.get("pickups", "roster", "employees")),
    "daily_counts": lambda s: ped_views.daily_counts(s["pickups"]),
    "daily_orders": lambda s: ped_views.daily_counts(
        s["order_master"], "order_created_date_local"
    ),
    "adjustment_counts": lambda s: ped_views.adjustment_counts(s["adjustments"]),
    # Units per pickup
    "upp_by_expert": lambda s: units.upp_by_expert(
        *s.get("items", "bridge", "transfers", "experts")
    ),
    "upp_by_product": lambda s: units.upp_by_product(
        *s.get("items", "bridge", "transfers", "products")
    ),
    "upp_by_market_geo": lambda s: units.upp_by_market_geo(
        *s.get(
            "items", "bridge", "transfers", "addresses", "zip_codes", "coverage_areas", "centers"
        )
    ),
    "upp_by_market_home": lambda s: units.upp_by_market_home(
        *s.get("items", "bridge", "transfers", "experts")
    ),
    "upp_overall": lambda s: units.upp_overall(*s.get("items", "bridge", "transfers")),
    # Travel
    "apportioned_travel": lambda s: travel.apportioned_travel(*_travel_tables(s)),
    "total_travel": lambda s: travel.total_travel(
        travel.apportioned_travel(*_travel_tables(s))
    ),
    "total_travel_by_date": lambda s: travel.total_travel_by_date(
        travel.apportioned_travel(*_travel_tables(s), by_market=False)
    ),
    "travel_share_of_shift": lambda s: travel.travel_share_of_shift(
        *s.get("shifts", "sched"), s.blocks_of(TRAVEL_EVENT), *s.get(*_PLACE), until=AS_OF
    ),
    "utilization_pvt": lambda s: travel.utilization_pvt(
        *s.get("shifts", "sched", "blocks", *_PLACE), first="2016-08-01", as_of=AS_OF
    ),
    "travel_hours_by_market": lambda s: travel.travel_hours_by_market(
        _pickup_trips(s), s["experts"]
    ),
    "travel_hours_by_expert": lambda s: travel.travel_hours_by_expert(
        _pickup_trips(s), s["experts"]
    ),
    "travel_hours_overall": lambda s: travel.travel_hours_overall(_pickup_trips(s)),
    "travel_metrics": lambda s: travel.travel_metrics(*_travel_tables(s)),
    "travel_metrics_spread": lambda s: travel.travel_metrics_spread(*_travel_tables(s)),
    "travel_metrics_of_partner": lambda s: travel.travel_metrics_spread(
        *_travel_tables(s),
        partner_orders=s["order_master"].where(partner_label() == CART_PARTNER),
    ),
    "visit_travel_rows": lambda s: _travel_rows(s),
    "visit_travel_rows_by_zone": lambda s: _zone_rows(s),
    "travel_stats": lambda s: travel.travel_stats(_travel_rows(s), "visit_date", "market"),
    "travel_stats_by_zone": lambda s: travel.travel_stats(
        _zone_rows(s), "zone", "visit_date", with_min=False
    ),
    "travel_stats_of_zone": lambda s: travel.travel_stats(_zone_rows(s), "zone", with_min=False),
    "travel_stats_by_period": lambda s: travel.travel_stats_by_period(
        _travel_rows(s, between=("2024-01-01", "2024-01-29")),
        CHANGE_DATE,
        "2024-01-01",
        "2024-01-29",
    ),
    "travel_samples": lambda s: travel.travel_samples(
        _travel_rows(s, skus=SAMPLE_SKUS), "visit_id", "visit_date", "market"
    ),
    "travel_sample_arrays": lambda s: _as_text(
        travel.sample_arrays(_travel_rows(s, skus=SAMPLE_SKUS), "visit_date"), "visit_date", "part"
    ),
    "travel_sample_arrays_by_zone": lambda s: _as_text(
        travel.sample_arrays(_zone_rows(s), "zone", "visit_date"), "zone", "visit_date", "part"
    ),
    "travel_sample_chunks": lambda s: _as_text(
        travel.chunked_arrays(_travel_rows(s), "market", length=CHUNK), "market", "chunk", "n"
    ),
    "travel_array_means": lambda s: travel.chunk_means(
        travel.chunked_arrays(_travel_rows(s), "visit_date", length=CHUNK), "visit_date"
    ),
    "travel_arrays_exploded": lambda s: travel.explode_arrays(
        travel.chunked_arrays(_travel_rows(s), "market", length=CHUNK), "market"
    ),
    # Orders
    "same_day_share": lambda s: orders.same_day_share(*s.get("visit_facts", "orders")),
    "same_day_share_by_market": lambda s: orders.same_day_share_by_market(
        *s.get("visit_facts", "orders", *_PLACE)
    ),
    "same_day_visit_cancel_share": lambda s: orders.same_day_visit_cancel_share(
        *s.get("visit_facts", "orders", *_PLACE)
    ),
    "same_day_order_cancels": lambda s: orders.same_day_order_cancels(
        *s.get("order_master", *_PLACE)
    ),
    "same_day_visit_cancels": lambda s: orders.same_day_visit_cancels(
        *s.get("visit_facts", *_PLACE)
    ),
    "cancel_summary": lambda s: orders.cancel_summary(
        *s.get("visit_facts", "order_master", *_PLACE)
    ),
    "cancel_share_by_hour": lambda s: orders.cancel_share_by_hour(s["order_master"]),
    "hourly_running_share": lambda s: orders.hourly_running_share(s["orders"]),
    "hourly_running_share_same_day": lambda s: orders.hourly_running_share_same_day(
        *s.get("visit_facts", "orders")
    ),
    "hourly_share_by_market": lambda s: orders.hourly_share_by_market(
        *s.get("visit_facts", "orders", *_PLACE)
    ),
    "hourly_running_share_by_market": lambda s: orders.hourly_running_share_by_market(
        *s.get("visit_facts", "orders", *_PLACE)
    ),
    "order_density": lambda s: orders.order_density(
        *s.get("orders", "addresses", "zip_codes", "zip_population")
    ),
    "order_density_rows": lambda s: orders.order_density_rows(
        *s.get("orders", "addresses", "zip_codes", "zip_population")
    ),
    "order_density_by_market": lambda s: orders.order_density_by_market(
        *s.get("orders", "addresses", "zip_codes", "zip_population")
    ),
    "fact_preview": lambda s: tables.preview(
        orders.fact_join(*s.get("visit_facts", "orders")), "visit_id"
    ),
    "sorted_markets": lambda s: tables.sorted_values(_events(s), "market"),
    # Reschedules
    "order_reschedules": lambda s: _history(s),
    "reschedules_simple_complex": lambda s: reschedules.reschedules_simple_complex(_history(s)),
    "rescheduled_orders": lambda s: reschedules.rescheduled_orders(_history(s)),
    "avg_reschedules": lambda s: reschedules.avg_reschedules(_history(s)),
    "reschedule_actor_mix": lambda s: reschedules.reschedule_actor_mix(
        *s.get("visits", "order_master", *_PLACE)
    ),
    "reschedule_summary": lambda s: reschedules.reschedule_summary(
        *s.get("visits", "order_master", *_PLACE)
    ),
    "same_day_reschedules": lambda s: reschedules.same_day_reschedules(
        *s.get("visits", "order_master", *_PLACE)
    ),
    # Deck
    "deck_roster_days": _roster,
    "deck_skilled_headcount": _headcount,
    "deck_planned_headcount": _planned,
    "deck_used_hours": _used_hours,
    "deck_shift_length_histogram": _shift_lengths,
    "deck_visit_counts": lambda s: deck.visit_counts(s["order_master"], AS_OF),
    "deck_booking_counts": lambda s: deck.booking_counts(s["order_master"], AS_OF),
    "deck_travel_avgs": lambda s: deck.travel_avgs(s["travel_times"], AS_OF),
    "deck_pickup_totals": _deck_pickups,
    "metrics_deck": _deck,
    # Experiments
    "experiment_label_period": lambda s: _periods(_market_samples(s), "exclude")
    .groupBy("market", "metric", "period")
    .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")),
    "experiment_two_weeks": lambda s: _periods(
        experiment.around(_samples(s), "day", CHANGE_DATE, days=14, inclusive=False)
    )
    .groupBy("day", "metric", "period")
    .agg(F.avg("value").alias("value")),
    "experiment_two_weeks_with_ends": lambda s: _periods(
        experiment.around(_samples(s), "day", CHANGE_DATE, days=14, inclusive=True), "before"
    )
    .groupBy("day", "metric", "period")
    .agg(F.avg("value").alias("value")),
    "experiment_until": lambda s: experiment.until(_samples(s), "day", "2024-01-30")
    .groupBy("day")
    .agg(F.count(F.lit(1)).alias("n")),
    "experiment_treatment": lambda s: experiment.select_treatment(
        _periods(_samples(s)), "zone", "LA-A"
    )
    .groupBy("zone", "period", "metric")
    .agg(F.count("value").alias("n")),
    "experiment_daily_means": lambda s: experiment.daily_means(
        _market_samples(s), "day", "market"
    ),
    "experiment_pooled_samples": lambda s: experiment.pooled_samples(
        _periods(_market_samples(s)), "market", "period"
    ),
    "experiment_describe_periods": lambda s: experiment.describe_periods(
        _periods(_market_samples(s)), "market"
    ),
    "experiment_welch_t": lambda s: experiment.welch_t(
        experiment.select_treatment(_periods(_samples(s)), "zone", "LA-A")
    ),
    "experiment_levene": lambda s: experiment.levene(_periods(_market_samples(s)), "market"),
    "experiment_bartlett": lambda s: experiment.bartlett(_periods(_market_samples(s)), "market"),
    "experiment_impact_summary": lambda s: experiment.impact_summary(_daily_travel(s), "market"),
    "experiment_impact_of_daily_stats": lambda s: experiment.unpivot_summary(
        experiment.wide_summary(
            experiment.impact_summary(_daily_stats(s), "market"), _STATS, "market"
        ),
        "market",
    ),
    "experiment_impact_of_daily_kpis": lambda s: experiment.impact_summary(
        _daily_kpis(s, two_weeks=False), "market"
    ),
    "experiment_impact_around_change": lambda s: experiment.impact_summary(
        _daily_kpis(s, two_weeks=True), "market"
    ),
    "experiment_zone_test": lambda s: experiment.impact_summary_full(_zone_samples(s)),
    "experiment_zone_test_daily": lambda s: experiment.impact_summary_full(
        experiment.daily_means(_zone_samples(s), "visit_date", "zone", "period")
    ),
    "experiment_impact_summary_full": lambda s: experiment.impact_summary_full(
        _periods(_market_samples(s), "exclude"), "market"
    ),
    "experiment_impact_summary_pooled": lambda s: experiment.impact_summary_full(
        _periods(_samples(s), "exclude")
    ),
    "experiment_variance_summary": lambda s: experiment.variance_summary(_periods(_samples(s))),
    "experiment_variance_summary_daily": lambda s: experiment.variance_summary(
        _periods(experiment.daily_means(_samples(s), "day"))
    ),
    "experiment_unpivot_summary": lambda s: experiment.unpivot_summary(
        experiment.wide_summary(
            experiment.impact_summary(_periods(_market_samples(s)), "market"),
            ["click", "error", "purchase", "signup", "view"],
            "market",
        ),
        "market",
    ),
    "experiment_improved": lambda s: experiment.improved(
        experiment.impact_summary(_periods(_market_samples(s)), "market")
    ),
    "experiment_value_histogram": lambda s: experiment.value_histogram(
        _periods(_samples(s)), "metric", "period"
    ),
    "experiment_distribution_summary": lambda s: experiment.distribution_summary(
        _periods(_market_samples(s)), "market", "metric", "period"
    ),
    "experiment_metric_series": lambda s: experiment.metric_series(
        _market_samples(s), "day", "market"
    ),
}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums of doubles depend on the order of the rows."""
    doubles = {f.name: _six(f.name) for f in df.schema if f.dataType.typeName() == "double"}
    return df.withColumns(doubles) if doubles else df


def _registered(build: Callable[[StarRoles], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(build(StarRoles(configure(spark), sf_dir)))

    return run


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship query: the metrics deck, on the smallest tables unless told."""
    return queries()["metrics_deck"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator as a query over the tables in a directory."""
    return {name: _registered(build) for name, build in _QUERIES.items()} | _CORPUS_QUERIES


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL."""
    return ORACLE | _CORPUS_ORACLE
