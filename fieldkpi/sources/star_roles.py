"""Field-service tables read out of a star schema plus an event log.

The operators take calendar blocks, transfers, visits, orders and so on. Where a
store holds only nation, region, customer, supplier, part, orders, lineitem and
events, each of those roles is a projection of one or two of its tables:

* events are calendar blocks, visits and stock pickups; five consecutive events
  share one order, one trip and one block event id, so ids collide across types;
* orders are customer orders and inventory transfers, their dates laid over the
  30 days of the event log, the price giving the time of day;
* lineitems are order items and the transfer bridge; later lines of an order
  travel with the next transfer, so orders and transfers are many to many;
* customers are experts and addresses, nations are centers, suppliers are zips
  and stock locations, parts are products.

No role needs a window or a sort. Shifts and calendar days are distinct values and the
planned headcount is a count, each reduced before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldkpi.sources.tables import read_table

AS_OF = "2024-01-31"
CHANGE_DATE = "2024-01-15"

# One time zone per region, one event type per log type.
_ZONES = {
    0: "Africa/Johannesburg",
    1: "America/Los_Angeles",
    2: "Asia/Kolkata",
    3: "Europe/Berlin",
    4: "Asia/Dubai",
}
_EVENT_TYPES = {
    "view": "InventoryTransfer",
    "click": "TravelTime",
    "purchase": "Visit",
    "signup": "PaidTimeOff",
    "error": "Meeting",
}
_ORDER_STATUS = {"F": "canceled", "O": "complete", "P": "scheduled"}
_VISIT_STATUS = {"error": "canceled", "purchase": "complete", "signup": "scheduled"}

_SECONDS_OF_DAY = "CAST(floor(o_totalprice) AS BIGINT) % 86400"
_CREATED = (
    "timestampadd(SECOND, "
    f"datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') % 30 * 86400 + {_SECONDS_OF_DAY}, "
    "TIMESTAMP_NTZ'2024-01-01 00:00:00')"
)
# A lineitem has no key of its own: order, line, part and supplier all but make one.
_ITEM = (
    "(l_orderkey * 8 + l_linenumber) * 1000003 + (l_partkey * 1009 + l_suppkey) % 1000003"
)
_EVENT_END = "timestampadd(SECOND, CAST(round(value * 60) AS BIGINT), ts)"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN {k!r} THEN {v!r}" for k, v in values.items()
    ) + " END"


class StarRoles:
    """Roles over one directory of Parquet tables; ``roles["visits"]`` is a DataFrame.

    Each table is opened, and each role defined, once per object, so a new object sees what
    the files hold now. Finding a schema takes a job that reads footers; a caller who knows
    the schemas may pass them in.
    """

    def __init__(
        self, spark: SparkSession, directory: str, schemas: dict[str, StructType] | None = None
    ):
        self._spark = spark
        self._directory = directory
        self._schemas = dict(schemas or {})
        self._tables: dict[str, DataFrame] = {}
        self._roles: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            schema = self._schemas.get(name)
            self._tables[name] = read_table(self._spark, self._directory, name, schema)
        return self._tables[name]

    def __getitem__(self, role: str) -> DataFrame:
        if role not in self._roles:
            self._roles[role] = _ROLES[role](self)
        return self._roles[role]

    def get(self, *roles: str) -> list[DataFrame]:
        return [self[r] for r in roles]

    def blocks_of(self, event_type: str) -> DataFrame:
        """The blocks of one type, chosen by the log's own type, which a scan can test."""
        role = f"blocks of {event_type}"
        if role not in self._roles:
            raw = [k for k, v in _EVENT_TYPES.items() if v == event_type]
            chosen = self.table("events").where(F.col("event_type").isin(raw))
            self._roles[role] = _as_blocks(chosen)
        return self._roles[role]


def _centers(s: StarRoles) -> DataFrame:
    return (
        s.table("nation")
        .join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(
            "CAST(n_nationkey AS BIGINT) AS id",
            "n_name AS name",
            "r_name AS market",
            "CAST(n_nationkey AS BIGINT) AS address_id",
            f"{_case('r_regionkey', _ZONES)} AS time_zone",
        )
    )


def _experts(s: StarRoles) -> DataFrame:
    return s.table("customer").selectExpr(
        "c_custkey AS expert_id",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Trainer' ELSE 'Expert' END AS expert_type",
        "split_part(c_name, '#', 1) AS expert_first_name",
        "split_part(c_name, '#', 2) AS expert_last_name",
        "CAST(c_nationkey AS BIGINT) AS current_enjoyment_house_id",
        "concat('NATION_', c_nationkey) AS current_enjoyment_house_name",
        "concat('NATION_', (c_nationkey + 7) % 25) AS home_enjoyment_house_name",
    )


def _blocks(s: StarRoles) -> DataFrame:
    return _as_blocks(s.table("events"))


def _as_blocks(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id",
        "event_id DIV 5 AS event_id",
        f"{_case('event_type', _EVENT_TYPES)} AS event_type",
        "ts AS start_time",
        f"{_EVENT_END} AS end_time",
        "value >= 2.0 AS enabled",
    )


def _sched(s: StarRoles) -> DataFrame:
    return s.table("events").selectExpr(
        "event_id AS calendar_block_id",
        "user_id AS expert_id",
        "user_id * 1000 + dayofyear(ts) AS shift_id",
    )


def _shifts(s: StarRoles) -> DataFrame:
    days = s.table("events").selectExpr("user_id", "CAST(ts AS DATE) AS d").dropDuplicates()
    start = "timestampadd(HOUR, user_id % 24, CAST(d AS TIMESTAMP_NTZ))"
    minutes = "(user_id * 7 + dayofyear(d)) % 16 * 60 + user_id * 11 % 60"
    return days.selectExpr(
        "user_id * 1000 + dayofyear(d) AS id",
        "user_id AS expert_id",
        f"{start} AS start_time",
        f"timestampadd(MINUTE, {minutes}, {start}) AS end_time",
        "(user_id + dayofyear(d)) % 10 <> 0 AS enabled",
    )


def _transfers(s: StarRoles) -> DataFrame:
    return s.table("orders").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS expert_id",
        "o_orderkey AS travel_time_id",
        "o_custkey DIV 30 AS inventory_location_id",
        "o_custkey AS meeting_address_id",
        f"{_CREATED} AS created_at",
    )


def _bridge(s: StarRoles) -> DataFrame:
    return s.table("lineitem").selectExpr(
        f"{_ITEM} AS id",
        "l_orderkey + l_linenumber DIV 4 AS inventory_transfer_id",
        f"{_ITEM} AS order_item_id",
    )


def _items(s: StarRoles) -> DataFrame:
    return s.table("lineitem").selectExpr(
        f"{_ITEM} AS id",
        "l_orderkey AS order_id",
        "CAST(l_partkey AS STRING) AS sku",
        "l_suppkey AS pick_up_location_id",
    )


def _order_master(s: StarRoles) -> DataFrame:
    canceled = f"timestampadd(SECOND, CAST(floor(o_totalprice) AS BIGINT) % 50000, {_CREATED})"
    return s.table("orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS expert_id",
        f"{_case('o_orderstatus', _ORDER_STATUS)} AS order_status",
        f"CAST({_CREATED} AS DATE) AS order_created_date_local",
        f"{_CREATED} AS order_created_ts_local",
        f"CAST(timestampadd(HOUR, -8, {_CREATED}) AS DATE) AS order_created_date_pt",
        f"CASE WHEN o_orderstatus <> 'O' THEN {canceled} END AS canceled_ts_utc",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Integration'"
        " ELSE 'Direct' END AS partner_channel",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS partner_id",
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS visit_id",
        f"date_add(CAST({_CREATED} AS DATE), 1) AS visit_date_local",
        "concat('NATION_', o_custkey % 25) AS visit_eh",
    )


def _orders(s: StarRoles) -> DataFrame:
    return s["order_master"].selectExpr(
        "order_id",
        "order_status",
        "order_created_date_local",
        "order_created_ts_local",
        "expert_id AS billing_address_id",
    )


def _visit_events(s: StarRoles) -> DataFrame:
    return s.table("events").where(F.col("event_type").isin(list(_VISIT_STATUS)))


def _visits(s: StarRoles) -> DataFrame:
    return _visit_events(s).selectExpr(
        "event_id AS id",
        "event_id DIV 5 AS order_id",
        "user_id AS expert_id",
        "event_id DIV 5 AS travel_time_id",
        "user_id AS meeting_address_id",
        "CASE WHEN value < 20 THEN 'Employee' WHEN value < 60 THEN 'Customer' END"
        " AS created_by_type",
        f"{_case('event_type', _VISIT_STATUS)} AS status",
        "CAST(timestampadd(HOUR, -6, ts) AS DATE) AS visit_created_date_local",
    )


def _visit_facts(s: StarRoles) -> DataFrame:
    created = "timestampadd(HOUR, -6, ts)"
    return _visit_events(s).selectExpr(
        "event_id AS visit_id",
        "event_id DIV 5 AS order_id",
        "user_id AS expert_id",
        f"{_case('event_type', _VISIT_STATUS)} AS visit_status",
        f"CAST({created} AS DATE) AS visit_created_date_local",
        f"{created} AS visit_created_ts_local",
        f"timestampadd(SECOND, CAST(round(value * 600) AS BIGINT), {created})"
        " AS visit_updated_ts_utc",
        "CAST(ts AS DATE) AS visit_start_date_local",
        f"CAST({_EVENT_END} AS DATE) AS visit_end_date_local",
    )


def _profile_changes(s: StarRoles) -> DataFrame:
    return (
        s.table("customer")
        .selectExpr(
            "c_custkey",
            "CAST(c_nationkey AS BIGINT) AS c_nationkey",
            "date_add(DATE'2024-01-01', CAST(c_custkey % 30 AS INT)) AS moved",
        )
        .selectExpr(
            "c_custkey AS expert_id",
            "inline(array("
            "named_struct('enjoyment_center_id', c_nationkey,"
            " 'effective_start_date', DATE'2023-12-01', 'effective_end_date', moved),"
            "named_struct('enjoyment_center_id', (c_nationkey + 1) % 25,"
            " 'effective_start_date', date_add(moved, 1),"
            " 'effective_end_date', DATE'2024-12-31')))",
        )
    )


def _badges(s: StarRoles) -> DataFrame:
    return s.table("region").selectExpr(
        "CAST(r_regionkey AS BIGINT) AS id",
        "CASE r_regionkey WHEN 0 THEN 'OPUS Ability' WHEN 1 THEN 'Sonos Ability'"
        " ELSE r_name END AS name",
    )


def _expert_badges(s: StarRoles) -> DataFrame:
    return s.table("customer").selectExpr(
        "c_custkey AS expert_id",
        "explode(array(c_custkey % 5, (c_custkey + 1) % 5)) AS badge_id",
        "timestampadd(HOUR, c_custkey % 20 * 24 + 3, TIMESTAMP_NTZ'2024-01-01 00:00:00')"
        " AS date_added",
    )


def _fiscal_dates(s: StarRoles) -> DataFrame:
    days = s.table("events").selectExpr("CAST(ts AS DATE) AS d").dropDuplicates()
    return days.selectExpr(
        "d AS fiscal_date",
        "weekofyear(d) AS fiscal_week_in_year",
        "date_add(d, 6 - weekday(d)) AS fiscal_week_end_date",
        f"weekofyear(d) - weekofyear(DATE'{AS_OF}') AS fiscal_week_offset",
        f"datediff(d, DATE'{AS_OF}') AS fiscal_day_offset",
    )


def _planned(s: StarRoles) -> DataFrame:
    return s.table("customer").groupBy(
        F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("ec_name")
    ).agg(F.count(F.lit(1)).alias("experts_lms"))


def _travel_times(s: StarRoles) -> DataFrame:
    place = s.table("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("id"))
    trips = s.table("events").where("event_type = 'click'")
    return (
        trips.join(place, F.col("user_id") == F.col("c_custkey"))
        .join(s["centers"].select("id", "market"), "id")
        .selectExpr(
            "market AS mkt_tt",
            "CAST(ts AS DATE) AS visit_date_local_tt",
            "value AS visit_travel_duration_minutes",
            "CASE WHEN value >= 5 THEN value / 3 END AS pickup_visit_travel_duration_minutes",
        )
    )


def _addresses(s: StarRoles) -> DataFrame:
    return s.table("customer").selectExpr(
        "c_custkey AS id",
        "c_custkey AS address_id",
        "lpad(CAST(c_custkey DIV 15 AS STRING), 5, '0') AS zip",
    )


def _zip_codes(s: StarRoles) -> DataFrame:
    return s.table("supplier").selectExpr(
        "lpad(CAST(s_suppkey AS STRING), 5, '0') AS zip",
        "concat('NATION_', s_nationkey) AS market",
        "CAST(s_nationkey AS BIGINT) AS coverage_area_id",
    )


def _coverage_areas(s: StarRoles) -> DataFrame:
    return s.table("nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id",
        "CAST((n_nationkey + 3) % 25 AS BIGINT) AS enjoyment_center_id",
    )


def _zip_population(s: StarRoles) -> DataFrame:
    return s.table("supplier").selectExpr(
        "lpad(CAST(s_suppkey AS STRING), 5, '0') AS zipcode",
        "format_number(CAST(floor(greatest(s_acctbal, 0.0D) * 10) AS BIGINT), 0) AS population",
        "CAST(CAST(floor(greatest(s_acctbal, 0.0D)) AS BIGINT) % 97 AS STRING) AS landsqmi",
    )


def _zip_zones(s: StarRoles) -> DataFrame:
    return s.table("supplier").selectExpr(
        "lpad(CAST(s_suppkey AS STRING), 5, '0') AS zip",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'LA-A' ELSE 'LA-B' END AS zone",
    )


def _locations(s: StarRoles) -> DataFrame:
    return s.table("supplier").selectExpr("s_suppkey AS id", "s_name AS name")


def _products(s: StarRoles) -> DataFrame:
    return s.table("part").selectExpr("CAST(p_partkey AS STRING) AS sku", "p_name AS description")


def _pickups(s: StarRoles) -> DataFrame:
    return (
        s.table("events")
        .where("event_type = 'view'")
        .selectExpr("user_id AS expert_id", "ts AS created_at")
    )


def _roster(s: StarRoles) -> DataFrame:
    return s.table("customer").selectExpr("c_custkey AS id", "c_custkey * 10 + 3 AS employee_id")


def _employees(s: StarRoles) -> DataFrame:
    return s.table("customer").selectExpr(
        "c_custkey * 10 + 3 AS id",
        "split_part(c_name, '#', 1) AS first_name",
        "split_part(c_name, '#', 2) AS last_name",
    )


def _adjustments(s: StarRoles) -> DataFrame:
    return s.table("lineitem").selectExpr("l_orderkey AS transaction_number")


_ROLES: dict[str, Callable[[StarRoles], DataFrame]] = {
    "centers": _centers,
    "experts": _experts,
    "blocks": _blocks,
    "sched": _sched,
    "shifts": _shifts,
    "transfers": _transfers,
    "bridge": _bridge,
    "items": _items,
    "order_master": _order_master,
    "orders": _orders,
    "visits": _visits,
    "visit_facts": _visit_facts,
    "profile_changes": _profile_changes,
    "badges": _badges,
    "expert_badges": _expert_badges,
    "fiscal_dates": _fiscal_dates,
    "planned": _planned,
    "travel_times": _travel_times,
    "addresses": _addresses,
    "zip_codes": _zip_codes,
    "coverage_areas": _coverage_areas,
    "zip_population": _zip_population,
    "zip_zones": _zip_zones,
    "locations": _locations,
    "products": _products,
    "pickups": _pickups,
    "roster": _roster,
    "employees": _employees,
    "adjustments": _adjustments,
}
ROLE_NAMES = tuple(_ROLES)
