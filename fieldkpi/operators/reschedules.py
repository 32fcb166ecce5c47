"""How often, and by whom, orders are rescheduled.

Each order is reduced to counts, an "any canceled" flag and its last status. All
three merge across partial aggregates, so no list of visits is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkpi.functions.labels import CANCELED, ratio
from fieldkpi.functions.times import DEFAULT_SINCE, Day, day, local_date
from fieldkpi.operators.located import at_home, by_day_and_market

# Fixed values of created_by_type; Unknown stands for null.
EMPLOYEE = "Employee"
CUSTOMER = "Customer"
UNKNOWN = "Unknown"


def visit_history(visits: DataFrame) -> DataFrame:
    """Per order: visits, whether any was canceled, and the status of the last.

    Visits without a creation time come last; ties go to the larger visit id.
    """
    created = F.col("visit_created_ts_local")
    position = F.struct(created.isNull(), created, F.col("visit_id"))
    return visits.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_visits"),
        F.coalesce(F.bool_or(F.col("visit_status") == CANCELED), F.lit(False)).alias("any_canceled"),
        F.max_by("visit_status", position).alias("last_status"),
    )


def order_reschedules(
    visits: DataFrame,
    order_master: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """Rows ``order_id, order_date, market, simple, complex, n_reschedules``."""
    return _orders_at_home(order_master, experts, centers, since).join(
        visit_history(visits), "order_id"
    ).select(
        "order_id",
        "order_date",
        "market",
        (F.col("n_visits") > 1).alias("simple"),
        (F.col("any_canceled") & (F.coalesce("last_status", F.lit(CANCELED)) != CANCELED)).alias(
            "complex"
        ),
        (F.col("n_visits") - 1).alias("n_reschedules"),
    )


def reschedules_simple_complex(history: DataFrame) -> DataFrame:
    """Orders with several visits, and with a canceled visit but not the last."""
    return by_day_and_market(
        history,
        F.count_if("simple").alias("n_simple"),
        F.count_if("complex").alias("n_complex"),
        F.count(F.lit(1)).alias("n_orders"),
        date="order_date",
    )


def rescheduled_orders(history: DataFrame) -> DataFrame:
    return by_day_and_market(
        history,
        F.count_if("simple").alias("n_reschedules"),
        F.count(F.lit(1)).alias("n_orders"),
        date="order_date",
    )


def avg_reschedules(history: DataFrame) -> DataFrame:
    """Mean number of reschedules of the orders that have any; null on other days."""
    return by_day_and_market(
        history,
        F.avg(F.when(F.col("simple"), F.col("n_reschedules"))).alias("avg_number_of_reschedules"),
        date="order_date",
    )


def visit_actors(visits: DataFrame) -> DataFrame:
    """Per order: visits made by employees, customers and unknown, and visits with a status."""
    actor = F.coalesce("created_by_type", F.lit(UNKNOWN))
    return visits.groupBy("order_id").agg(
        F.count_if(actor == EMPLOYEE).alias("n_employee"),
        F.count_if(actor == CUSTOMER).alias("n_customer"),
        F.count_if(actor == UNKNOWN).alias("n_unknown"),
        F.count(F.lit(1)).alias("total_visits"),
        F.count("status").alias("n_visits"),
    )


def reschedule_actor_mix(
    visits: DataFrame,
    order_master: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """Mean share of each actor over orders with several visits."""
    several = visit_actors(visits).where(F.col("total_visits") > 1)
    rows = _orders_at_home(order_master, experts, centers, since).join(several, "order_id")
    return by_day_and_market(
        rows,
        *(
            F.avg(ratio(f"n_{who}", "total_visits")).alias(f"share_{who}")
            for who in ("employee", "customer", "unknown")
        ),
        date="order_date",
    )


def reschedule_summary(
    visits: DataFrame,
    order_master: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """Rescheduled orders, their mean number of reschedules, and visits by actor."""
    rows = _orders_at_home(order_master, experts, centers, since).join(
        visit_actors(visits), "order_id"
    )
    several = F.col("n_visits") > 1
    return by_day_and_market(
        rows,
        F.count_if(several).alias("n_rescheduled_orders"),
        F.avg(F.when(several, F.col("n_visits") - 1)).alias("avg_reschedules_per_order"),
        F.sum("n_employee").alias("n_employee"),
        F.sum("n_customer").alias("n_customer"),
        F.sum("n_unknown").alias("n_unknown"),
        date="order_date",
    )


def same_day_reschedules(
    visits: DataFrame,
    order_master: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day = DEFAULT_SINCE,
) -> DataFrame:
    """Visit totals, with those made on the day the live order was canceled.

    Visits are counted per order and creation day, which is all the same-day test
    needs to know about them.
    """
    per_day = (
        visits.withColumn("actor", F.coalesce("created_by_type", F.lit(UNKNOWN)))
        .groupBy("order_id", "visit_created_date_local")
        .agg(
            F.count("status").alias("n_visits"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("actor") == EMPLOYEE).alias("n_employee"),
            F.count_if(F.col("actor") == CUSTOMER).alias("n_customer"),
            F.count_if(F.col("actor") == UNKNOWN).alias("n_unknown"),
        )
    )
    orders = _orders_at_home(
        order_master, experts, centers, since, "order_status", "canceled_ts_utc", "time_zone"
    )
    canceled_day = local_date("canceled_ts_utc", "time_zone")
    same_day = (F.col("order_status") != CANCELED) & (
        F.col("visit_created_date_local") == canceled_day
    )
    per_order = (
        orders.join(per_day, "order_id")
        .groupBy("order_id", "order_date", "market")
        .agg(
            F.sum("n_visits").alias("n_visits"),
            F.sum(F.when(same_day, F.col("n_rows")).otherwise(0)).alias("n_same_day"),
            *(F.sum(f"n_{who}").alias(f"n_{who}") for who in ("employee", "customer", "unknown")),
        )
    )
    return by_day_and_market(
        per_order,
        F.sum("n_visits").alias("total_rescheduled_visits"),
        F.sum("n_same_day").alias("total_same_day_rescheduled_visits"),
        F.sum("n_employee").alias("total_employee_reschedules"),
        F.sum("n_customer").alias("total_customer_reschedules"),
        F.sum("n_unknown").alias("total_unknown_reschedules"),
        F.count_if(F.col("n_visits") > 1).alias("n_rescheduled_orders"),
        date="order_date",
    )


def _orders_at_home(
    order_master: DataFrame,
    experts: DataFrame,
    centers: DataFrame,
    since: Day,
    *keep: str,
) -> DataFrame:
    recent = order_master.where(F.col("order_created_date_local") > day(since))
    return at_home(recent, experts, centers).select(
        "order_id", F.col("order_created_date_local").alias("order_date"), "market", *keep
    )
