"""Same-day share, cancellations, hours of the day and order density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldkpi.functions.labels import CANCELED, grouped_number, percent, ratio
from fieldkpi.functions.times import DEFAULT_SINCE, Day, could_be_after, day, local_date
from fieldkpi.operators.located import at_home, by_day_and_market


def ordered_visits(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Visits with the status, creation day and creation time of their order."""
    order = orders.select(
        "order_id", "order_status", "order_created_date_local", "order_created_ts_local"
    )
    return visits.select(
        "visit_id",
        "order_id",
        "expert_id",
        "visit_status",
        "visit_start_date_local",
        "visit_end_date_local",
    ).join(order, "order_id")


def fact_join(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """All columns of visits and their orders; shared names come from the visit."""
    new = [c for c in orders.columns if c not in visits.columns]
    return visits.join(orders.select("order_id", *new), "order_id")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("order_status") != CANCELED) & (F.col("visit_status") != CANCELED))


_ENDS_SAME_DAY = "order_created_date_local = visit_end_date_local"
_STARTS_SAME_DAY = "order_created_date_local = visit_start_date_local"


def same_day_share(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Fraction of visits that end on the day of the order, one row."""
    return _kept(ordered_visits(visits, orders)).agg(
        ratio(F.count_if(F.expr(_ENDS_SAME_DAY)), F.count(F.lit(1))).alias("same_day_share")
    )


def same_day_share_by_market(
    visits: DataFrame,
    orders: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """Percentage per day and market; a day without same-day visits has 0."""
    rows = _kept(ordered_visits(visits, orders)).where(
        F.col("visit_start_date_local") > day(since)
    )
    counts = (
        at_home(rows, experts, centers)
        .groupBy(F.col("visit_start_date_local").alias("delivery_date"), "market")
        .agg(
            F.count_if(F.expr(_ENDS_SAME_DAY)).alias("n_same_day_deliveries"),
            F.count(F.lit(1)).alias("n_deliveries"),
        )
    )
    return counts.withColumn(
        "percent_of_same_day_deliveries", percent("n_same_day_deliveries", "n_deliveries")
    ).orderBy("delivery_date", "market")


def same_day_visit_cancel_share(
    visits: DataFrame,
    orders: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """Canceled fraction of the visits planned for the day of the order."""
    rows = ordered_visits(visits, orders).where(
        F.expr(_ENDS_SAME_DAY) & (F.col("visit_start_date_local") > day(since))
    )
    counts = (
        at_home(rows, experts, centers)
        .groupBy(F.col("visit_start_date_local").alias("event_date"), "market")
        .agg(
            F.count_if(F.col("visit_status") == CANCELED).alias("same_day_cancelations"),
            F.count(F.lit(1)).alias("total_visits"),
        )
    )
    return counts.withColumn(
        "cancelation_share", ratio("same_day_cancelations", "total_visits")
    ).orderBy("event_date", "market")


def same_day_order_cancels(
    order_master: DataFrame, experts: DataFrame, centers: DataFrame, since: Day = DEFAULT_SINCE
) -> DataFrame:
    """Orders canceled on the local day they were made."""
    recent = order_master.where(
        (F.col("order_created_date_local") > day(since))
        & could_be_after("canceled_ts_utc", since)
    ).select("expert_id", "order_created_date_local", "canceled_ts_utc")
    same_day = at_home(recent, experts, centers).where(
        F.col("order_created_date_local") == local_date("canceled_ts_utc", "time_zone")
    )
    return by_day_and_market(
        same_day.withColumnRenamed("order_created_date_local", "event_date"),
        F.count(F.lit(1)).alias("cancelled_orders"),
    )


def same_day_visit_cancels(
    visits: DataFrame, experts: DataFrame, centers: DataFrame, since: Day = DEFAULT_SINCE
) -> DataFrame:
    """Visits canceled on the local day they were made.

    The last update stands for the time of cancellation. Days with updates but
    no cancellation are kept with 0.
    """
    recent = visits.where(
        (F.col("visit_created_date_local") > day(since))
        & could_be_after("visit_updated_ts_utc", since)
    ).select("expert_id", "visit_created_date_local", "visit_updated_ts_utc", "visit_status")
    same_day = at_home(recent, experts, centers).where(
        F.col("visit_created_date_local") == local_date("visit_updated_ts_utc", "time_zone")
    )
    return by_day_and_market(
        same_day.withColumnRenamed("visit_created_date_local", "event_date"),
        F.count_if(F.col("visit_status") == CANCELED).alias("canceled_visits"),
    )


def cancel_summary(
    visits: DataFrame,
    order_master: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """The three same-day cancellation counts for days that have all of them."""
    both = same_day_visit_cancel_share(visits, order_master, experts, centers, since).select(
        "event_date", "market", F.col("same_day_cancelations").alias("visit_order_cancellations")
    )
    keys = ["event_date", "market"]
    return (
        both.join(same_day_visit_cancels(visits, experts, centers, since), keys)
        .join(same_day_order_cancels(order_master, experts, centers, since), keys)
        .orderBy(*keys)
    )


def cancel_share_by_hour(order_master: DataFrame) -> DataFrame:
    """Percentage of cancellations in each UTC hour, from one scan."""
    hours = (
        order_master.where(F.col("order_status") == CANCELED)
        .groupBy(F.hour("canceled_ts_utc").alias("order_canceled_hour"))
        .agg(F.count("order_id").alias("n"), F.count(F.lit(1)).alias("rows"))
    )
    # At most 25 rows reach this window, so one partition is enough.
    return hours.select(
        "order_canceled_hour",
        percent("n", F.sum("rows").over(Window.partitionBy())).alias("percent_of_cancelations"),
    ).orderBy("order_canceled_hour")


def hourly_running_share(orders: DataFrame) -> DataFrame:
    """Percentage of orders made up to and including each hour of the day."""
    return _running(orders.groupBy(_hour()).agg(F.count(F.lit(1)).alias("n")))


def hourly_running_share_same_day(visits: DataFrame, orders: DataFrame) -> DataFrame:
    rows = ordered_visits(visits, orders).where(
        F.expr(_STARTS_SAME_DAY) & (F.col("order_status") != CANCELED)
    )
    return _running(rows.groupBy(_hour()).agg(F.count(F.lit(1)).alias("n")))


def hourly_share_by_market(
    visits: DataFrame, orders: DataFrame, experts: DataFrame, centers: DataFrame
) -> DataFrame:
    """Percentage of a market's same-day orders made in each hour."""
    hours = _hours_by_market(visits, orders, experts, centers)
    whole = F.sum("n").over(Window.partitionBy("market"))
    return hours.select(
        "market", "order_hour", percent("n", whole).alias("percent_of_orders")
    ).orderBy("market", "order_hour")


def hourly_running_share_by_market(
    visits: DataFrame, orders: DataFrame, experts: DataFrame, centers: DataFrame
) -> DataFrame:
    hours = _hours_by_market(visits, orders, experts, centers)
    return _running(hours, "market")


def _hour():
    return F.hour("order_created_ts_local").alias("order_hour")


def _hours_by_market(
    visits: DataFrame, orders: DataFrame, experts: DataFrame, centers: DataFrame
) -> DataFrame:
    rows = _kept(ordered_visits(visits, orders)).where(F.expr(_STARTS_SAME_DAY))
    return (
        at_home(rows, experts, centers)
        .groupBy("market", _hour())
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _running(hours: DataFrame, *keys: str) -> DataFrame:
    """Running percentage over hours; at most 25 rows per key arrive here."""
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy("order_hour").rowsBetween(Window.unboundedPreceding, 0)
    return hours.select(
        *keys,
        "order_hour",
        percent(F.sum("n").over(so_far), F.sum("n").over(whole)).alias("running_percent"),
    ).orderBy(*keys, "order_hour")


def orders_by_zip(orders: DataFrame, addresses: DataFrame) -> DataFrame:
    """Orders per zip; counted per address first so a busy address joins once."""
    per_address = orders.groupBy(F.col("billing_address_id").alias("address_id")).agg(
        F.count("order_id").alias("n_orders")
    )
    return (
        per_address.join(addresses.select("address_id", "zip"), "address_id")
        .groupBy("zip")
        .agg(F.sum("n_orders").alias("n_orders"))
    )


def order_density_rows(
    orders: DataFrame, addresses: DataFrame, zip_codes: DataFrame, zip_population: DataFrame
) -> DataFrame:
    """Orders, people and land of every known zip, with its market."""
    people = zip_population.select(
        F.col("zipcode").alias("zip"),
        grouped_number("population").alias("population"),
        F.col("landsqmi").cast("double").alias("landsqmi"),
    )
    return (
        orders_by_zip(orders, addresses)
        .join(zip_codes.select("zip", "market"), "zip")
        .join(people, "zip")
        .select("zip", "market", "n_orders", "population", "landsqmi")
    )


def _densities() -> list:
    return [
        (ratio("n_orders", "population") * 1000.0).alias("orders_per_thousand_people"),
        ratio("n_orders", "landsqmi").alias("orders_per_sq_mile"),
    ]


def order_density(
    orders: DataFrame, addresses: DataFrame, zip_codes: DataFrame, zip_population: DataFrame
) -> DataFrame:
    """Orders per 1,000 people and per square mile of zips that have both."""
    rows = order_density_rows(orders, addresses, zip_codes, zip_population)
    return rows.where((F.col("population") != 0) & (F.col("landsqmi") != 0)).select(
        "zip", *_densities()
    )


def order_density_by_market(
    orders: DataFrame, addresses: DataFrame, zip_codes: DataFrame, zip_population: DataFrame
) -> DataFrame:
    """The zips of a market taken together."""
    totals = (
        order_density_rows(orders, addresses, zip_codes, zip_population)
        .groupBy("market")
        .agg(*(F.sum(c).alias(c) for c in ("n_orders", "population", "landsqmi")))
    )
    return totals.select("*", *_densities()).orderBy("market")
