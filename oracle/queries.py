"""Expected results of the registered queries as DuckDB SQL.

Written apart from the operators: plain joins and grouping over the roles, with
none of their pre-aggregation. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from oracle.roles import with_roles


def r(expression: str, name: str) -> str:
    """Six places, by way of ten: a value half way between two results is then the
    same decimal in both engines, whatever the last bit of its double."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38, 10)), 6) AS DOUBLE) AS {name}"


def r2(expression: str, name: str) -> str:
    """Two-place rounding of the decimal value, as of numeric columns."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38, 10)), 2) AS DOUBLE) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


PICKED = "(SELECT * FROM located WHERE event_type = 'InventoryTransfer')"
PARTNER = "o.channel = 'Integration' AND o.partner_id = 1"
PARTNER_ROWS = f"""
    SELECT e.event_date, e.market, e.expert_id, t.id AS transfer_id, b.id AS bridge_id,
           o.order_status
    FROM order_master o JOIN items i ON i.order_id = o.order_id
    JOIN bridge b ON b.item_id = i.id JOIN transfers t ON t.id = b.transfer_id
    JOIN {PICKED} e ON e.event_id = t.id
    WHERE {PARTNER}"""

_SQL: dict[str, str] = {}

# --- pickups ---------------------------------------------------------------

_SQL["located_events"] = f"""
SELECT event_id, expert_id, event_date, market, center_market, {r('minutes', 'minutes')}
FROM {PICKED}"""

_SQL["ped"] = f"""
SELECT event_date, market, {r('AVG(n)', 'ped')}
FROM (SELECT event_date, market, expert_id, COUNT(*) AS n FROM {PICKED} GROUP BY ALL)
GROUP BY event_date, market"""

_SQL["ped_check"] = f"""
WITH rate AS (
    SELECT event_date, market, AVG(n) AS ped
    FROM (SELECT event_date, market, expert_id, COUNT(*) AS n FROM {PICKED} GROUP BY ALL)
    GROUP BY event_date, market),
parts AS (
    SELECT e.event_date, e.market, COUNT(DISTINCT t.expert_id) AS n_experts,
           COUNT(t.id) AS n_pickups
    FROM {PICKED} e JOIN transfers t ON t.id = e.event_id GROUP BY e.event_date, e.market)
SELECT event_date, market, n_experts, n_pickups, {r('ped', 'ped')},
       {r('n_pickups / n_experts', 'div')}
FROM rate JOIN parts USING (event_date, market)"""

_SQL["ped_upp_components"] = f"""
SELECT event_date, market, COUNT(transfer_id) AS n_pickups,
       COUNT(DISTINCT expert_id) AS n_experts, {big('SUM(n)', 'total_units')}
FROM (SELECT e.event_date, e.market, e.expert_id, t.id AS transfer_id, COUNT(b.id) AS n
      FROM {PICKED} e JOIN transfers t ON t.id = e.event_id JOIN bridge b ON b.transfer_id = t.id
      GROUP BY ALL)
GROUP BY event_date, market"""

_SQL["partner_ped"] = f"""
SELECT event_date, market, {r('AVG(n)', 'ped')}
FROM (SELECT event_date, market, expert_id, COUNT(DISTINCT transfer_id) AS n
      FROM ({PARTNER_ROWS}) GROUP BY ALL)
GROUP BY event_date, market"""

_SQL["partner_upp"] = f"""
SELECT event_date, market, {r('AVG(n)', 'units_per_pickup')}
FROM (SELECT event_date, market, transfer_id, COUNT(bridge_id) AS n
      FROM ({PARTNER_ROWS}) WHERE order_status <> 'canceled' GROUP BY ALL)
GROUP BY event_date, market"""

_SQL["partner_components"] = f"""
SELECT event_date, market, COUNT(transfer_id) AS n_pickups,
       COUNT(DISTINCT expert_id) AS n_experts, {big('SUM(n)', 'total_units')}
FROM (SELECT event_date, market, expert_id, transfer_id, COUNT(bridge_id) AS n
      FROM ({PARTNER_ROWS}) GROUP BY ALL)
GROUP BY event_date, market"""

_SQL["upp"] = f"""
SELECT event_date, market, {r('AVG(n_units)', 'units_per_pickup')},
       COUNT(n_units) AS pickups_per_day
FROM {PICKED} e JOIN units u ON u.transfer_id = e.event_id GROUP BY event_date, market"""

_SQL["travel_to_pickup"] = f"""
SELECT event_date, market, {r('AVG(minutes)', 'travel_minutes')}
FROM located e JOIN transfers t ON t.travel_time_id = e.event_id
WHERE e.event_type = 'TravelTime' GROUP BY event_date, market"""

_SQL["pickup_duration"] = f"""
SELECT event_date, market, {r('AVG(minutes)', 'pickup_duration')}
FROM {PICKED} GROUP BY event_date, market"""

_SQL["pickup_duration_per_unit"] = f"""
SELECT event_date, market, {r('AVG(minutes / n_units)', 'avg_pickup_duration_per_unit')}
FROM {PICKED} e JOIN units u ON u.transfer_id = e.event_id WHERE n_units <> 0
GROUP BY event_date, market"""

_SQL["pickup_units_histogram"] = """
SELECT n_units AS n_items, COUNT(*) AS n_pickups FROM units GROUP BY n_units"""

_SQL["pickup_class_mix"] = f"""
SELECT event_date AS pickup_date, market,
       {big('SUM(CASE WHEN n_units < 1 THEN 1 ELSE 0 END)', 'n_zero_pickups')},
       {big('SUM(CASE WHEN n_units = 1 THEN 1 ELSE 0 END)', 'n_single_pickups')},
       {big('SUM(CASE WHEN n_units > 1 THEN 1 ELSE 0 END)', 'n_bulk_pickups')},
       COUNT(*) AS total_pickups,
       {r('100.0 * AVG(CASE WHEN n_units < 1 THEN 1.0 ELSE 0 END)', 'percent_zero_pickups')},
       {r('100.0 * AVG(CASE WHEN n_units = 1 THEN 1.0 ELSE 0 END)', 'percent_single_pickups')},
       {r('100.0 * AVG(CASE WHEN n_units > 1 THEN 1.0 ELSE 0 END)', 'percent_bulk_pickups')}
FROM {PICKED} e JOIN units u ON u.transfer_id = e.event_id GROUP BY event_date, market"""

# --- pickup rates ----------------------------------------------------------

_T_DAILY = """(SELECT expert_id, CAST(created_at AS DATE) AS d, COUNT(*) AS n
               FROM transfers GROUP BY ALL)"""
_P_DAILY = """(SELECT user_id AS expert_id, CAST(ts AS DATE) AS d, COUNT(*) AS n
               FROM events WHERE event_type = 'view' GROUP BY ALL)"""


def _expert_rates(daily: str) -> str:
    return f"(SELECT expert_id, AVG(n) AS rate FROM {daily} GROUP BY expert_id)"


_SQL["ped_by_location"] = f"""
SELECT location, {r2('AVG(rate)', 'ped')}
FROM (SELECT location, expert_id, AVG(n) AS rate
      FROM (SELECT s_name AS location, t.expert_id, CAST(t.created_at AS DATE) AS d,
                   COUNT(t.id) AS n
            FROM supplier LEFT JOIN transfers t ON t.inventory_location_id = s_suppkey
            GROUP BY ALL)
      GROUP BY location, expert_id)
GROUP BY location"""

_SQL["ped_by_sku"] = f"""
SELECT x.sku, p_name AS description, {r2('x.rate', 'avg_daily_pickups')}
FROM (SELECT sku, AVG(rate) AS rate
      FROM (SELECT expert_id, sku, AVG(n) AS rate
            FROM (SELECT created_date, expert_id, sku, COUNT(*) AS n FROM item_moves GROUP BY ALL)
            GROUP BY expert_id, sku)
      GROUP BY sku) x
JOIN part ON CAST(p_partkey AS VARCHAR) = x.sku"""

def _by_week(daily: str) -> str:
    return f"""
SELECT x.expert_id, e.full_name AS expert, {r2('AVG(x.n)', 'avg_weekly_pickups')}
FROM (SELECT f.week_end, d.expert_id, SUM(d.n) AS n
      FROM {daily} d JOIN fiscal_dates f ON f.fiscal_date = d.d GROUP BY ALL) x
JOIN experts e ON e.expert_id = x.expert_id
GROUP BY x.expert_id, e.full_name"""


_SQL["ped_by_week"] = _by_week(_T_DAILY)
_SQL["ped_by_week_of_pickups"] = _by_week(_P_DAILY)


def _by_region(daily: str) -> str:
    return f"""
SELECT e.house_name AS market, {r2('AVG(x.rate)', 'ped')}
FROM {_expert_rates(daily)} x LEFT JOIN experts e ON e.expert_id = x.expert_id
GROUP BY e.house_name"""


def _by_expert(daily: str) -> str:
    return f"""
SELECT x.expert_id, e.full_name AS expert, {r2('x.rate', 'ped')}
FROM {_expert_rates(daily)} x JOIN experts e ON e.expert_id = x.expert_id"""


_SQL["ped_by_region"] = _by_region(_T_DAILY)
_SQL["ped_by_region_of_pickups"] = _by_region(_P_DAILY)
_SQL["ped_by_expert"] = _by_expert(_T_DAILY)
_SQL["ped_by_expert_of_pickups"] = _by_expert(_P_DAILY)
_SQL["ped_overall"] = f"SELECT {r2('AVG(rate)', 'avg_ped')} FROM {_expert_rates(_T_DAILY)}"
_SQL["ped_overall_of_roster"] = f"""
SELECT {r2('AVG(rate)', 'avg_ped')}
FROM {_expert_rates(_P_DAILY)} x JOIN customer ON c_custkey = x.expert_id"""
_SQL["entity_counts"] = """
SELECT c_custkey AS expert_id, c_custkey * 10 + 3 AS employee_id,
       split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
       COUNT(*) AS n_pickups
FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' GROUP BY ALL"""
_SQL["daily_counts"] = """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events WHERE event_type = 'view'
GROUP BY CAST(ts AS DATE)"""
_SQL["daily_orders"] = """
SELECT created_date AS day, COUNT(*) AS n FROM order_master GROUP BY created_date"""
_SQL["adjustment_counts"] = """
SELECT l_orderkey AS transaction_number, COUNT(*) AS n_adjustments FROM lineitem
GROUP BY l_orderkey"""

# --- units -----------------------------------------------------------------

_PICKUP_ITEMS = """(SELECT transfer_id, expert_id, meeting_address_id, COUNT(*) AS n
                    FROM item_moves GROUP BY ALL)"""
_SQL["upp_by_expert"] = f"""
SELECT x.expert_id, e.full_name AS expert, {r2('AVG(x.n)', 'avg_units_per_pickup')}
FROM {_PICKUP_ITEMS} x JOIN experts e ON e.expert_id = x.expert_id
GROUP BY x.expert_id, e.full_name"""
_SQL["upp_by_product"] = f"""
SELECT x.sku, p_name AS description, {r2('AVG(x.n)', 'avg_num_per_pickup')}
FROM (SELECT transfer_id, sku, COUNT(*) AS n FROM item_moves GROUP BY ALL) x
JOIN part ON CAST(p_partkey AS VARCHAR) = x.sku
GROUP BY x.sku, p_name"""
_SQL["upp_by_market_geo"] = f"""
SELECT market, {r2('AVG(n)', 'units_per_pickup')}
FROM (SELECT x.transfer_id, c.market, SUM(x.n) AS n
      FROM {_PICKUP_ITEMS} x JOIN addresses a ON a.id = x.meeting_address_id
      JOIN zips z ON z.zip = a.zip JOIN areas g ON g.id = z.area_id
      JOIN centers c ON c.id = g.center_id
      GROUP BY ALL)
GROUP BY market"""
_SQL["upp_by_market_home"] = f"""
SELECT e.home_name AS market, {r('AVG(x.n)', 'avg_units_per_pickups')}
FROM {_PICKUP_ITEMS} x JOIN experts e ON e.expert_id = x.expert_id GROUP BY e.home_name"""
_SQL["upp_overall"] = f"SELECT {r2('AVG(n)', 'avg_units_per_pickup')} FROM {_PICKUP_ITEMS}"

# --- travel ----------------------------------------------------------------

_SQL["apportioned_travel"] = f"""
SELECT visit_id, visit_date, market, {r('MIN(ttt)', 'total_travel_time')}
FROM travel_rows GROUP BY visit_id, visit_date, market"""
_SQL["total_travel"] = f"""
SELECT visit_date, market, {r('AVG(t)', 'avg_total_travel_time')}
FROM (SELECT visit_id, visit_date, market, MIN(ttt) AS t FROM travel_rows GROUP BY ALL)
GROUP BY visit_date, market"""
_SQL["total_travel_by_date"] = f"""
SELECT visit_date, {r('AVG(t)', 'avg_total_travel_time')}
FROM (SELECT visit_id, visit_date, MIN(ttt) AS t FROM travel_rows GROUP BY ALL)
GROUP BY visit_date"""

_SHIFT_EVENTS = """
    SELECT sh.id AS shift_id, h.market, sh.start_time,
           CAST(sh.start_time AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS local_day,
           CAST(date_diff('microsecond', sh.start_time, sh.end_time) AS DOUBLE) / 6e7 AS shift_len,
           CAST(date_diff('microsecond', b.start_time, b.end_time) AS DOUBLE) / 6e7 AS len,
           b.event_type
    FROM shifts sh JOIN sched s ON s.shift_id = sh.id JOIN blocks b ON b.id = s.calendar_block_id
    JOIN homes h ON h.expert_id = s.expert_id
    WHERE sh.enabled AND b.enabled"""
_SQL["travel_share_of_shift"] = f"""
SELECT local_day AS shift_date, market, {r('100 * AVG(part)', 'average_shift_travel_percent')}
FROM (SELECT shift_id, local_day, market, SUM(len) / NULLIF(shift_len, 0) AS part
      FROM ({_SHIFT_EVENTS}) WHERE event_type = 'TravelTime'
      GROUP BY shift_id, local_day, market, shift_len)
GROUP BY local_day, market"""
_SQL["utilization_pvt"] = f"""
SELECT shift_date, market, {r('SUM(pvt)', 'total_pvt')}, {r('SUM(shift_len)', 'total_shift_time')},
       {r('SUM(pvt) / NULLIF(SUM(shift_len), 0) * 100', 'utilization_percent')}
FROM (SELECT shift_id, CAST(start_time AS DATE) AS shift_date, market, shift_len, SUM(len) AS pvt
      FROM ({_SHIFT_EVENTS}) WHERE event_type IN ('InventoryTransfer', 'TravelTime', 'Visit')
      GROUP BY ALL)
WHERE shift_date BETWEEN DATE '2016-08-01' AND DATE '2024-01-31'
GROUP BY shift_date, market"""

_HOURS = "(SELECT p.expert_id, p.minutes / 60 AS h FROM trips p JOIN transfers t ON t.travel_time_id = p.event_id)"
_SQL["travel_hours_by_market"] = f"""
SELECT e.house_name AS market, {r2('AVG(h)', 'avg_travel_time')}
FROM {_HOURS} x JOIN experts e ON e.expert_id = x.expert_id GROUP BY e.house_name"""
_SQL["travel_hours_by_expert"] = f"""
SELECT x.expert_id, e.full_name AS expert, {r2('AVG(h)', 'avg_travel_time')}
FROM {_HOURS} x JOIN experts e ON e.expert_id = x.expert_id GROUP BY x.expert_id, e.full_name"""
_SQL["travel_hours_overall"] = f"SELECT {r2('AVG(h)', 'avg_travel_time')} FROM {_HOURS}"


def _travel_metrics(spread: bool, exact: bool = False) -> str:
    def show(expression: str, name: str) -> str:
        return f"{expression} AS {name}" if exact else r(expression, name)

    extra_agg = extra = ""
    if spread:
        extra_agg = ", STDDEV_SAMP(ptt) AS sd, MAX(ptt) AS hi, MIN(ptt) AS lo"
        extra = (
            f", {show('sd', 'std_pickup_travel_time')}, {show('hi', 'max_pickup_travel_time')},"
            f" {show('lo', 'min_pickup_travel_time')}"
        )
    return f"""
WITH own AS (
    SELECT CAST(o.start_time AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS visit_date,
           h.market, AVG(o.minutes) AS vtt
    FROM visits v JOIN item_moves m ON m.order_id = v.order_id
    JOIN trips o ON o.event_id = v.travel_time_id JOIN homes h ON h.expert_id = o.expert_id
    GROUP BY ALL),
pick AS (
    SELECT CAST(p.start_time AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS visit_date,
           h.market, AVG(p.ptt) AS ptt, AVG(p.pttpv) AS pttpv{extra_agg}
    FROM pickup_trips p JOIN homes h ON h.expert_id = p.expert_id GROUP BY ALL),
total AS (
    SELECT visit_date, market, AVG(t) AS ttt
    FROM (SELECT visit_id, visit_date, market, MIN(ttt) AS t FROM travel_rows GROUP BY ALL)
    GROUP BY visit_date, market)
SELECT visit_date, market, {show('vtt', 'visit_travel_time')}, {show('ptt', 'pickup_travel_time')},
       {show('pttpv', 'pickup_travel_time_per_visit')}, {show('ttt', 'avg_total_travel_time')}{extra}
FROM total JOIN own USING (visit_date, market) JOIN pick USING (visit_date, market)"""


_SQL["travel_metrics"] = _travel_metrics(False)
_SQL["travel_metrics_spread"] = _travel_metrics(True)

_SQL["travel_metrics_of_partner"] = f"""
WITH cart_visits AS (
    SELECT v.* FROM visits v JOIN order_master o ON o.order_id = v.order_id WHERE {PARTNER}),
cart_trips AS (
    SELECT n.transfer_id, p.expert_id, p.start_time, p.minutes AS ptt,
           p.minutes / n.n_visits AS pttpv
    FROM (SELECT m.transfer_id, m.travel_time_id, COUNT(v.id) AS n_visits
          FROM item_moves m JOIN cart_visits v ON v.order_id = m.order_id GROUP BY ALL) n
    JOIN trips p ON p.event_id = n.travel_time_id),
cart_rows AS (
    SELECT v.id AS visit_id, h.market, o.minutes + p.pttpv AS ttt,
           CAST(o.start_time AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS visit_date
    FROM cart_visits v JOIN item_moves m ON m.order_id = v.order_id
    JOIN trips o ON o.event_id = v.travel_time_id
    JOIN cart_trips p ON p.transfer_id = m.transfer_id JOIN homes h ON h.expert_id = v.expert_id)
""" + (
    _travel_metrics(True)
    .strip()
    .replace("WITH own", ", own", 1)
    .replace("FROM visits v", "FROM cart_visits v")
    .replace("pickup_trips p", "cart_trips p")
    .replace("FROM travel_rows", "FROM cart_rows")
)

_M = ("vtt", "ptt", "pttpv", "ttt")
_ROUNDED_M = ", ".join(r(m, m) for m in _M)
_ZONED = """(SELECT DISTINCT t.visit_id, t.visit_date, t.market, z.zone, vtt, ptt, pttpv, ttt
             FROM travel_rows t JOIN addresses a ON a.id = t.meeting_address_id
             JOIN zips z ON z.zip = a.zip)"""
_BY_SKU = """(SELECT DISTINCT visit_id, visit_date, market, vtt, ptt, pttpv, ttt
              FROM travel_rows WHERE CAST(sku AS BIGINT) BETWEEN 0 AND 199)"""


def _stats(with_min: bool) -> str:
    kinds = {"min": "MIN", "max": "MAX", "avg": "AVG", "std": "STDDEV_SAMP"}
    if not with_min:
        del kinds["min"]
    return ", ".join(r(f"{fn}({m})", f"{k}_{m}") for m in _M for k, fn in kinds.items())


_SQL["visit_travel_rows"] = f"""
SELECT visit_id, visit_date, market, {_ROUNDED_M} FROM visit_travel"""
_SQL["visit_travel_rows_by_zone"] = f"""
SELECT visit_id, visit_date, market, zone, {_ROUNDED_M} FROM {_ZONED}"""
_SQL["travel_stats"] = f"""
SELECT visit_date, market, {_stats(True)} FROM visit_travel GROUP BY visit_date, market"""
_SQL["travel_stats_by_zone"] = f"""
SELECT zone, visit_date, {_stats(False)} FROM {_ZONED} GROUP BY zone, visit_date"""
_SQL["travel_stats_of_zone"] = f"SELECT zone, {_stats(False)} FROM {_ZONED} GROUP BY zone"
_SQL["travel_stats_by_period"] = f"""
SELECT label AS market, {_stats(True)}
FROM (SELECT *, market || CASE WHEN visit_date < DATE '2024-01-15' THEN '-before'
                               ELSE '-after' END AS label
      FROM visit_travel WHERE visit_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-29')
GROUP BY label"""
_SQL["travel_samples"] = " UNION ALL ".join(
    f"SELECT visit_id, visit_date, market, '{m}' AS metric, {r(m, 'value')} FROM {_BY_SKU}"
    for m in _M
)
_LISTS = ", ".join(
    "array_to_string(list_transform(list_sort(list("
    f"{m})), lambda v: CAST(CAST(ROUND(CAST(v AS DECIMAL(38, 10)), 6) * 1000000 AS BIGINT)"
    f" AS VARCHAR)), ',') AS {m}"
    for m in _M
)
_SQL["travel_sample_arrays"] = f"""
SELECT visit_date, CAST(0 AS INTEGER) AS part, {_LISTS} FROM {_BY_SKU} GROUP BY visit_date"""
_SQL["travel_sample_arrays_by_zone"] = f"""
SELECT zone, visit_date, CAST(0 AS INTEGER) AS part, {_LISTS} FROM {_ZONED}
GROUP BY zone, visit_date"""
_SQL["travel_sample_chunks"] = f"""
SELECT market, chunk, COUNT(*) AS n, {_LISTS}
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY market
                 ORDER BY visit_id NULLS FIRST, vtt, ptt, pttpv, ttt) - 1) // 100 AS INTEGER) AS chunk
      FROM visit_travel)
GROUP BY market, chunk"""
_SQL["travel_array_means"] = f"""
SELECT visit_date, {', '.join(r(f'AVG({m})', m) for m in _M)} FROM visit_travel
GROUP BY visit_date"""
_SQL["travel_arrays_exploded"] = " UNION ALL ".join(
    f"SELECT market, '{m}' AS metric, {r(m, 'value')} FROM visit_travel" for m in _M
)

# --- levels of time and place ------------------------------------------------

_LEVELS = """
    CASE WHEN GROUPING(event_date) = 0 THEN 'day' WHEN GROUPING(week) = 0 THEN 'week'
         ELSE 'month' END AS time_level,
    COALESCE(event_date, week, month) AS period_start,
    CASE WHEN GROUPING(market) = 0 THEN 'market' WHEN GROUPING(center_market) = 0 THEN 'region'
         ELSE 'all' END AS place_level,
    COALESCE(market, center_market) AS place"""
_SETS = "GROUP BY GROUPING SETS (" + ", ".join(
    f"({when}{where})"
    for when in ("event_date", "week", "month")
    for where in (", market", ", center_market", "")
) + ")"
_DATED = f"""(SELECT *, CAST(date_trunc('week', event_date) AS DATE) AS week,
    CAST(date_trunc('month', event_date) AS DATE) AS month FROM {PICKED})"""
_SQL["ped_levels"] = f"""
SELECT {_LEVELS}, {big('SUM(n)', 'n_pickups')}, COUNT(*) AS n_expert_days, {r('AVG(n)', 'ped')}
FROM (SELECT event_date, week, month, market, center_market, expert_id, COUNT(*) AS n
      FROM {_DATED} GROUP BY ALL)
{_SETS}"""
_SQL["upp_levels"] = f"""
SELECT {_LEVELS}, COUNT(n_units) AS n_pickups, {big('SUM(n_units)', 'n_units')},
       {r('AVG(n_units)', 'units_per_pickup')}
FROM {_DATED} e JOIN units u ON u.transfer_id = e.event_id
{_SETS}"""
def _rates_within(carried: str, entity: str) -> str:
    sets = _SETS.replace("(event_date", f"({entity}, event_date").replace(
        "(week", f"({entity}, week").replace("(month", f"({entity}, month")
    return f"""
WITH carried AS ({carried}),
pickups AS (
    SELECT DISTINCT event_date, week, month, market, center_market, {entity}, expert_id,
           transfer_id, c.n_units
    FROM {_DATED} e JOIN carried c ON c.transfer_id = e.event_id),
expert_days AS (
    SELECT event_date, week, month, market, center_market, {entity}, expert_id,
           COUNT(*) AS n, SUM(n_units) AS units
    FROM pickups GROUP BY ALL)
SELECT {_LEVELS}, {entity}, {big('SUM(n)', 'n_pickups')}, COUNT(*) AS n_expert_days,
       {big('SUM(units)', 'n_units')}, {r('SUM(n) / COUNT(*)', 'ped')},
       {r('SUM(units) / SUM(n)', 'units_per_pickup')}
FROM expert_days
{sets}"""


_SQL["partner_rate_levels"] = _rates_within(
    f"""SELECT b.transfer_id, CASE WHEN {PARTNER} THEN 'ATT.com (Cart)' ELSE 'Other' END AS partner,
               COUNT(*) AS n_units
        FROM bridge b JOIN items i ON i.id = b.item_id JOIN order_master o ON o.order_id = i.order_id
        GROUP BY ALL""",
    "partner",
)
_SQL["location_rate_levels"] = _rates_within(
    """SELECT t.id AS transfer_id, l.s_name AS location, u.n_units
       FROM transfers t JOIN supplier l ON l.s_suppkey = t.inventory_location_id
       JOIN units u ON u.transfer_id = t.id""",
    "location",
)
_SQL["distinct_expert_levels"] = f"""
SELECT {_LEVELS}, {big('COUNT(DISTINCT expert_id)', 'n_experts')} FROM {_DATED} {_SETS}"""

# --- orders ----------------------------------------------------------------

_LIVE = "order_status <> 'canceled' AND status <> 'canceled'"
_ALL_VISITS = """(SELECT v.*, o.order_status, o.created_date AS order_date, o.created AS order_created
                  FROM visits v JOIN order_master o ON o.order_id = v.order_id)"""
_SQL["same_day_share"] = f"""
SELECT {r('AVG(CASE WHEN order_date = end_date THEN 1.0 ELSE 0 END)', 'same_day_share')}
FROM {_ALL_VISITS} WHERE {_LIVE}"""
_SQL["same_day_share_by_market"] = f"""
SELECT start_date AS delivery_date, market,
       COUNT(*) FILTER (order_date = end_date) AS n_same_day_deliveries,
       COUNT(*) AS n_deliveries,
       {r('100.0 * COUNT(*) FILTER (order_date = end_date) / COUNT(*)',
          'percent_of_same_day_deliveries')}
FROM placed_visits WHERE {_LIVE} GROUP BY start_date, market"""
_BOTH = """SELECT start_date AS event_date, market,
       COUNT(*) FILTER (status = 'canceled') AS same_day_cancelations, COUNT(*) AS total_visits
FROM placed_visits WHERE order_date = end_date GROUP BY start_date, market"""
_SQL["same_day_visit_cancel_share"] = f"""
SELECT *, {r('same_day_cancelations / total_visits', 'cancelation_share')} FROM ({_BOTH})"""
_ORDER_CANCELS = """SELECT created_date AS event_date, market, COUNT(*) AS cancelled_orders
FROM placed_orders WHERE created_date = canceled_date GROUP BY created_date, market"""
_SQL["same_day_order_cancels"] = _ORDER_CANCELS
_VISIT_CANCELS = """SELECT v.created_date AS event_date, h.market,
       COUNT(*) FILTER (v.status = 'canceled') AS canceled_visits
FROM visits v JOIN homes h ON h.expert_id = v.expert_id
WHERE v.created_date = CAST(v.updated AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE)
GROUP BY v.created_date, h.market"""
_SQL["same_day_visit_cancels"] = _VISIT_CANCELS
_SQL["cancel_summary"] = f"""
SELECT event_date, market, same_day_cancelations AS visit_order_cancellations, canceled_visits,
       cancelled_orders
FROM ({_BOTH}) JOIN ({_VISIT_CANCELS}) USING (event_date, market)
JOIN ({_ORDER_CANCELS}) USING (event_date, market)"""
_SQL["cancel_share_by_hour"] = f"""
SELECT CAST(hour(canceled_at) AS INTEGER) AS order_canceled_hour,
       {r("100.0 * COUNT(order_id) / (SELECT COUNT(*) FROM order_master WHERE order_status = 'canceled')", 'percent_of_cancelations')}
FROM order_master WHERE order_status = 'canceled' GROUP BY hour(canceled_at)"""


def _running(rows: str, stamp: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}CAST(h AS INTEGER) AS order_hour,
       {r(f'100.0 * SUM(n) OVER ({part} ORDER BY h) / SUM(n) OVER ({part})', 'running_percent')}
FROM (SELECT {lead}hour({stamp}) AS h, COUNT(*) AS n FROM {rows} GROUP BY ALL)"""


_SQL["hourly_running_share"] = _running("order_master", "created")
_SQL["hourly_running_share_same_day"] = _running(
    f"(SELECT * FROM {_ALL_VISITS} WHERE order_date = start_date AND order_status <> 'canceled')",
    "order_created",
)
_MARKET_HOURS = f"(SELECT * FROM placed_visits WHERE order_date = start_date AND {_LIVE})"
_SQL["hourly_share_by_market"] = f"""
SELECT market, CAST(h AS INTEGER) AS order_hour,
       {r('100.0 * n / SUM(n) OVER (PARTITION BY market)', 'percent_of_orders')}
FROM (SELECT market, hour(order_created) AS h, COUNT(*) AS n FROM {_MARKET_HOURS} GROUP BY ALL)"""
_SQL["hourly_running_share_by_market"] = _running(_MARKET_HOURS, "order_created", "market")

_ZIP_ORDERS = """(SELECT z.zip, z.market, COUNT(o.order_id) AS n_orders, z.population, z.land
                  FROM order_master o JOIN addresses a ON a.id = o.expert_id
                  JOIN zips z ON z.zip = a.zip GROUP BY ALL)"""
_DENSITY = (
    f"{r('n_orders / NULLIF(population, 0) * 1000', 'orders_per_thousand_people')},"
    f" {r('n_orders / NULLIF(land, 0)', 'orders_per_sq_mile')}"
)
_SQL["order_density"] = f"""
SELECT zip, {_DENSITY} FROM {_ZIP_ORDERS} WHERE population <> 0 AND land <> 0"""
_SQL["order_density_rows"] = f"""
SELECT zip, market, n_orders, population, land AS landsqmi FROM {_ZIP_ORDERS}"""
_SQL["order_density_by_market"] = f"""
SELECT market, n_orders, population, landsqmi, {_DENSITY.replace('land,', 'landsqmi,')}
FROM (SELECT market, {big('SUM(n_orders)', 'n_orders')}, {big('SUM(population)', 'population')},
             SUM(land) AS landsqmi
      FROM {_ZIP_ORDERS} GROUP BY market)"""
_SQL["fact_preview"] = f"""
SELECT id AS visit_id, order_id, expert_id, status AS visit_status,
       created_date AS visit_created_date_local, created AS visit_created_ts_local,
       updated AS visit_updated_ts_utc, start_date AS visit_start_date_local,
       end_date AS visit_end_date_local, order_status, order_date AS order_created_date_local,
       order_created AS order_created_ts_local, billing AS billing_address_id
FROM (SELECT v.*, o.order_status, o.created_date AS order_date, o.created AS order_created,
             o.expert_id AS billing
      FROM visits v JOIN order_master o ON o.order_id = v.order_id)
ORDER BY visit_id LIMIT 10"""
_SQL["sorted_markets"] = f"SELECT DISTINCT market FROM {PICKED}"

# --- reschedules -----------------------------------------------------------

_HISTORY = """(
    SELECT o.order_id, o.created_date AS order_date, o.market, x.n > 1 AS simple,
           list_contains(x.visits, 'canceled') AND x.visits[-1] <> 'canceled' AS complex,
           x.n - 1 AS n_reschedules
    FROM (SELECT order_id, list(status ORDER BY created, id) AS visits, COUNT(*) AS n
          FROM visits GROUP BY order_id) x
    JOIN placed_orders o ON o.order_id = x.order_id)"""
_SQL["order_reschedules"] = f"""
SELECT order_id, order_date, market, simple, complex, n_reschedules FROM {_HISTORY}"""
_SQL["reschedules_simple_complex"] = f"""
SELECT order_date, market, COUNT(*) FILTER (simple) AS n_simple,
       COUNT(*) FILTER (complex) AS n_complex, COUNT(*) AS n_orders
FROM {_HISTORY} GROUP BY order_date, market"""
_SQL["rescheduled_orders"] = f"""
SELECT order_date, market, COUNT(*) FILTER (simple) AS n_reschedules, COUNT(*) AS n_orders
FROM {_HISTORY} GROUP BY order_date, market"""
_SQL["avg_reschedules"] = f"""
SELECT order_date, market,
       {r('AVG(CASE WHEN simple THEN n_reschedules END)', 'avg_number_of_reschedules')}
FROM {_HISTORY} GROUP BY order_date, market"""

_ACTORS = ("employee", "customer", "unknown")
_ACTOR_COUNTS = ", ".join(
    f"COUNT(*) FILTER (v.actor = '{a.capitalize()}') AS n_{a}" for a in _ACTORS
)
_PER_ORDER = f"""(
    SELECT o.order_id, o.created_date AS order_date, o.market, {_ACTOR_COUNTS},
           COUNT(v.status) AS n_visits,
           COUNT(*) FILTER (o.order_status <> 'canceled' AND v.created_date = o.canceled_date)
           AS n_same_day
    FROM visits v JOIN placed_orders o ON o.order_id = v.order_id GROUP BY ALL)"""
_SQL["reschedule_actor_mix"] = f"""
SELECT order_date, market, {', '.join(r(f'AVG(n_{a} / n_visits)', f'share_{a}') for a in _ACTORS)}
FROM {_PER_ORDER} WHERE n_visits > 1 GROUP BY order_date, market"""
_SQL["reschedule_summary"] = f"""
SELECT order_date, market, COUNT(*) FILTER (n_visits > 1) AS n_rescheduled_orders,
       {r('AVG(CASE WHEN n_visits > 1 THEN n_visits - 1 END)', 'avg_reschedules_per_order')},
       {', '.join(big(f'SUM(n_{a})', f'n_{a}') for a in _ACTORS)}
FROM {_PER_ORDER} GROUP BY order_date, market"""
_SQL["same_day_reschedules"] = f"""
SELECT order_date, market, {big('SUM(n_visits)', 'total_rescheduled_visits')},
       {big('SUM(n_same_day)', 'total_same_day_rescheduled_visits')},
       {', '.join(big(f'SUM(n_{a})', f'total_{a}_reschedules') for a in _ACTORS)},
       COUNT(*) FILTER (n_visits > 1) AS n_rescheduled_orders
FROM {_PER_ORDER} GROUP BY order_date, market"""

# --- deck ------------------------------------------------------------------

_IN_RANGE = "BETWEEN DATE '2016-09-26' AND DATE '2024-02-07'"
_LOCAL = "CAST({ts} AT TIME ZONE 'UTC' AT TIME ZONE {zone} AS DATE)"
_SHIFT_ROWS = f"""(
    SELECT sh.*, x.house_name, {_LOCAL.format(ts='sh.start_time', zone='c.time_zone')} AS home_day,
           CAST(date_diff('microsecond', sh.start_time, sh.end_time) AS DOUBLE) / 3.6e9 AS hours
    FROM shifts sh JOIN experts x ON x.expert_id = sh.expert_id JOIN centers c ON c.id = x.house_id
    WHERE x.expert_type = 'Expert')"""
_ROSTER = f"""(
    SELECT DISTINCT {_LOCAL.format(ts='s.start_time', zone='c.time_zone')} AS start_date_local,
           c.name AS house, c.market, s.expert_id
    FROM {_SHIFT_ROWS} s JOIN profile_changes p ON p.expert_id = s.expert_id
         AND {_LOCAL.format(ts='s.start_time', zone="'America/Los_Angeles'")}
             BETWEEN p.first_day AND p.last_day
    JOIN centers c ON c.id = p.center_id
    WHERE s.home_day {_IN_RANGE} AND s.expert_id NOT IN (113, 139, 355))"""
_HEADCOUNT = f"""
    SELECT r.start_date_local, r.house AS current_enjoyment_house_name, r.market,
           COUNT(DISTINCT r.expert_id) AS experts_shift,
           COUNT(DISTINCT r.expert_id) FILTER (g.name = 'OPUS Ability') AS experts_opus,
           COUNT(DISTINCT r.expert_id) FILTER (g.name = 'Sonos Ability') AS experts_sonos
    FROM {_ROSTER} r
    LEFT JOIN (SELECT h.expert_id, k.name,
                      {_LOCAL.format(ts='h.date_added', zone="'America/Los_Angeles'")} AS since
               FROM expert_badges h JOIN badges k ON k.id = h.badge_id) g
         ON g.expert_id = r.expert_id AND g.since <= r.start_date_local
    GROUP BY ALL"""
_PLANNED = f"""
    SELECT fiscal_date AS start_date_local, ec_name AS current_enjoyment_house_name, experts_lms
    FROM fiscal_dates CROSS JOIN planned WHERE fiscal_date {_IN_RANGE}"""
_PVT = "('Pickup', 'Visit', 'TravelTime', 'Relay', 'Reservation', 'InventoryTransfer')"


def _used(rounded: bool) -> str:
    hours = "CAST(date_diff('microsecond', b.start_time, b.end_time) AS DOUBLE) / 3.6e9"
    kinds = {
        "used_hours": "TRUE",
        "used_hours_pvt": f"b.event_type IN {_PVT}",
        "used_hours_nvb": f"b.event_type NOT IN {_PVT}",
        "used_hours_pto": "b.event_type IN ('PaidTimeOff', 'paid_time_off')",
        "pickup_duration": "b.event_type IN ('Pickup', 'InventoryTransfer')",
    }
    sums = {k: f"SUM(CASE WHEN {test} THEN {hours} END)" for k, test in kinds.items()}
    cols = ", ".join(r(e, k) if rounded else f"{e} AS {k}" for k, e in sums.items())
    return f"""
    SELECT sh.home_day AS start_date_local, sh.house_name AS current_enjoyment_house_name, {cols}
    FROM {_SHIFT_ROWS} sh JOIN sched s ON s.shift_id = sh.id
    JOIN blocks b ON b.id = s.calendar_block_id
    WHERE b.enabled AND sh.home_day {_IN_RANGE} GROUP BY ALL"""


_CLASSES = ", ".join(
    f"COUNT(*) FILTER (sh.hours >= {h}" + ("" if h == 14 else f" AND sh.hours < {h + 1}")
    + f") AS shift_{h:02d}_hour"
    for h in range(15)
)
_LENGTHS = f"""
    SELECT sh.home_day AS start_date_local, sh.house_name AS current_enjoyment_house_name,
           {_CLASSES}, {r('SUM(sh.hours)', 'shift_hours')}
    FROM {_SHIFT_ROWS} sh JOIN {_ROSTER} a ON a.expert_id = sh.expert_id
         AND a.house = sh.house_name AND a.start_date_local = sh.home_day
    WHERE sh.enabled AND CAST(sh.start_time AS DATE) {_IN_RANGE} GROUP BY ALL"""
_VISIT_COUNTS = f"""
    SELECT visit_date AS start_date_local, visit_eh AS current_enjoyment_house_name,
           COUNT(visit_id) AS visits,
           COUNT(CASE WHEN {PARTNER.replace('o.', '')} THEN visit_id END) AS visits_att_cart
    FROM order_master WHERE order_status <> 'canceled' AND visit_date {_IN_RANGE} GROUP BY ALL"""
_BOOKINGS = f"""
    SELECT created_date_pt AS start_date_local, visit_eh AS current_enjoyment_house_name,
           COUNT(order_id) AS booked_orders,
           COUNT(*) FILTER (order_status = 'canceled') AS cancelations
    FROM order_master WHERE created_date_pt {_IN_RANGE} GROUP BY ALL"""
_TRAVEL_AVGS = f"""
    SELECT market, day AS start_date_local, {r('AVG(visit_minutes)', 'avg_visit_tt')},
           {r('AVG(pickup_minutes)', 'avg_pickup_tt')}
    FROM travel_times WHERE day {_IN_RANGE} GROUP BY ALL"""
_TOTALS = f"""
    SELECT event_date AS start_date_local, center_market AS market,
           {big('SUM(n_units)', 'num_units_in_pickup')}, COUNT(n_units) AS num_pickups
    FROM {PICKED} e JOIN units u ON u.transfer_id = e.event_id
    WHERE event_date BETWEEN DATE '2016-09-25' AND DATE '2024-01-30' GROUP BY ALL"""
_SQL["deck_roster_days"] = f"""
SELECT start_date_local, house AS current_enjoyment_house_name, market, expert_id
FROM {_ROSTER}"""
_SQL["deck_skilled_headcount"] = _HEADCOUNT
_SQL["deck_planned_headcount"] = _PLANNED
_SQL["deck_used_hours"] = _used(True)
_SQL["deck_shift_length_histogram"] = _LENGTHS
_SQL["deck_visit_counts"] = _VISIT_COUNTS
_SQL["deck_booking_counts"] = _BOOKINGS
_SQL["deck_travel_avgs"] = _TRAVEL_AVGS
_SQL["deck_pickup_totals"] = _TOTALS
_HOUSE_DAY = "(start_date_local, current_enjoyment_house_name)"
_ZERO_WHEN_ABSENT = ("visits", "visits_att_cart", "booked_orders", "cancelations")
_SQL["metrics_deck"] = f"""
SELECT * EXCLUDE (market, label) REPLACE (
    label AS current_enjoyment_house_name,
    {', '.join(f'COALESCE({c}, 0) AS {c}' for c in _ZERO_WHEN_ABSENT)})
FROM ({_HEADCOUNT})
JOIN ({_PLANNED}) USING {_HOUSE_DAY}
JOIN ({_used(True)}) USING {_HOUSE_DAY}
JOIN ({_LENGTHS}) USING {_HOUSE_DAY}
LEFT JOIN ({_VISIT_COUNTS}) USING {_HOUSE_DAY}
LEFT JOIN ({_BOOKINGS}) USING {_HOUSE_DAY}
LEFT JOIN ({_TRAVEL_AVGS}) USING (market, start_date_local)
LEFT JOIN ({_TOTALS}) USING (market, start_date_local)
JOIN (SELECT name AS current_enjoyment_house_name, label FROM centers)
     USING (current_enjoyment_house_name)
JOIN (SELECT fiscal_date AS start_date_local, week_end AS fiscal_week_end_date,
             week_offset AS fiscal_week_offset, day_offset AS fiscal_day_offset
      FROM fiscal_dates) USING (start_date_local)"""

# --- experiments -----------------------------------------------------------

_PERIOD = "CASE WHEN day < DATE '2024-01-15' THEN 'before' ELSE 'after' END AS period"
_RAW = """(SELECT event_type AS metric, value, CAST(ts AS DATE) AS day,
                  CASE WHEN user_id % 2 = 0 THEN 'LA-A' ELSE 'LA-B' END AS zone FROM events)"""
_RAW_MARKET = """(SELECT event_type AS metric, value, CAST(ts AS DATE) AS day, h.market
                  FROM events JOIN homes h ON h.expert_id = user_id)"""
_NOT_CHANGE_DAY = "day <> DATE '2024-01-15'"


def _labelled(rows: str, where: str = "TRUE") -> str:
    return f"(SELECT *, {_PERIOD} FROM {rows} WHERE {where})"


def _pairs(rows: str, keys: str) -> str:
    """Moments of both periods on one row per group."""
    agg = ", ".join(
        f"{fn} FILTER (period = '{p}') AS {p}_{name}"
        for p in ("before", "after")
        for name, fn in (
            ("n", "COUNT(value)"),
            ("mean", "AVG(value)"),
            ("var", "VAR_SAMP(value)"),
            ("std", "STDDEV_POP(value)"),
        )
    )
    return f"(SELECT {keys}, {agg} FROM {rows} GROUP BY {keys})"


def _t_rows(rows: str, keys: str) -> str:
    """Welch score, degrees of freedom and two-sided p per group.

    p integrates the density of t = sqrt(df) tan(u) by Simpson's rule, in which the
    density becomes a power of the cosine.
    """
    return f"""(
    SELECT *, {_t_tail('t_score', 'df')} AS p_value
    FROM (SELECT *, (before_mean - after_mean) / NULLIF(SQRT(a + b), 0) AS t_score,
                 (a + b) * (a + b)
                 / NULLIF(a * a / NULLIF(before_n - 1, 0) + b * b / NULLIF(after_n - 1, 0), 0) AS df
          FROM (SELECT *, before_var / before_n AS a, after_var / after_n AS b
                FROM {_pairs(rows, keys)})))"""


def _t_tail(t: str, df: str) -> str:
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    angle = f"atan(abs({t}) / sqrt({df}))"
    total = (
        f"list_sum([{weight} * pow(cos({angle} * i / 2000), {df} - 1) for i in range(0, 2001)])"
    )
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return (
        f"CASE WHEN {t} IS NOT NULL AND {df} IS NOT NULL"
        f" THEN greatest(0, 1 - 2 * {scale} * {angle} / 2000 / 3 * {total}) END"
    )


def _chi_tail(x: str) -> str:
    """One degree of freedom: the normal density integrated over |z| <= sqrt(x)."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    total = (
        f"list_sum([{weight} * exp(-0.5 * pow(sqrt({x}) * i / 2000, 2)) for i in range(0, 2001)])"
    )
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * sqrt({x}) / 2000 / 3 * {total})"


def _levene_rows(rows: str, keys: str) -> str:
    by = f"{keys}, period"
    on = " AND ".join(f"x.{k.strip()} = c.{k.strip()}" for k in by.split(","))
    lead = ", ".join(f"x.{k.strip()}" for k in by.split(","))
    return f"""(
    SELECT *, {_t_tail('SQRT(levene)', 'levene_df2')} AS levene_p
    FROM (SELECT {keys}, COUNT(DISTINCT period) - 1 AS levene_df1,
                 COUNT(*) - COUNT(DISTINCT period) AS levene_df2,
                 (COUNT(*) - COUNT(DISTINCT period)) * SUM(pow(zi - zz, 2))
                 / ((COUNT(DISTINCT period) - 1) * SUM(pow(z - zi, 2))) AS levene
          FROM (SELECT *, AVG(z) OVER (PARTITION BY {by}) AS zi,
                       AVG(z) OVER (PARTITION BY {keys}) AS zz
                FROM (SELECT {lead}, ABS(x.value - c.med) AS z
                      FROM {rows} x
                      JOIN (SELECT {by}, MEDIAN(value) AS med FROM {rows} GROUP BY {by}) c
                      ON {on}))
          GROUP BY {keys}))"""


def _bartlett_rows(rows: str, keys: str) -> str:
    return f"""(
    SELECT *, {_chi_tail('bartlett')} AS bartlett_p
    FROM (SELECT {keys}, k - 1 AS bartlett_df,
                 ((n - k) * LN(sq / (n - k)) - logs) / (1 + (inv - 1 / (n - k)) / (3 * (k - 1)))
                 AS bartlett
          FROM (SELECT {keys}, COUNT(*) AS k, SUM(n) AS n, SUM((n - 1) * v) AS sq,
                       SUM((n - 1) * LN(v)) AS logs, SUM(1 / (n - 1)) AS inv
                FROM (SELECT {keys}, period, COUNT(value) AS n, VAR_SAMP(value) AS v
                      FROM {rows} GROUP BY {keys}, period)
                GROUP BY {keys})))"""


_SQL["experiment_label_period"] = f"""
SELECT market, metric, period, COUNT(*) AS n, {r('SUM(value)', 'total')}
FROM {_labelled(_RAW_MARKET, _NOT_CHANGE_DAY)} GROUP BY market, metric, period"""
_SQL["experiment_two_weeks"] = f"""
SELECT day, metric, period, {r('AVG(value)', 'value')}
FROM {_labelled(_RAW, "day > DATE '2024-01-01' AND day < DATE '2024-01-29'")}
GROUP BY day, metric, period"""
_SQL["experiment_two_weeks_with_ends"] = f"""
SELECT day, metric, period, {r('AVG(value)', 'value')}
FROM (SELECT *, CASE WHEN day <= DATE '2024-01-15' THEN 'before' ELSE 'after' END AS period
      FROM {_RAW} WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-29')
GROUP BY day, metric, period"""
_SQL["experiment_until"] = f"""
SELECT day, COUNT(*) AS n FROM {_RAW} WHERE day < DATE '2024-01-30' GROUP BY day"""
_TREATED = f"(SELECT * FROM {_labelled(_RAW)} WHERE period = 'before' OR zone = 'LA-A')"
_SQL["experiment_treatment"] = f"""
SELECT zone, period, metric, COUNT(value) AS n FROM {_TREATED} GROUP BY zone, period, metric"""
_SQL["experiment_daily_means"] = f"""
SELECT market, day, metric, {r('AVG(value)', 'value')} FROM {_RAW_MARKET} GROUP BY ALL"""
_SQL["experiment_pooled_samples"] = f"""
SELECT market, period, metric, {r('value', 'value')} FROM {_labelled(_RAW_MARKET)}"""
_SQL["experiment_describe_periods"] = f"""
SELECT market, metric, period, COUNT(value) AS n, {r('AVG(value)', 'mean')},
       {r('MEDIAN(value)', 'median')}, {r('STDDEV_POP(value)', 'std')}
FROM {_labelled(_RAW_MARKET)} GROUP BY market, metric, period"""
_SQL["experiment_welch_t"] = f"""
SELECT metric, {', '.join(
    f'{p}_n' if m == 'n' else r(f'{p}_{m}', f'{p}_{m}')
    for p in ('before', 'after') for m in ('n', 'mean', 'var', 'std'))},
       {r('t_score', 't_score')}, {r('df', 'df')}, {r('p_value', 'p_value')}
FROM {_t_rows(_TREATED, 'metric')}"""
_SQL["experiment_levene"] = f"""
SELECT market, metric, {r('levene', 'levene')}, levene_df1, levene_df2, {r('levene_p', 'levene_p')}
FROM {_levene_rows(_labelled(_RAW_MARKET), 'market, metric')}"""
_SQL["experiment_bartlett"] = f"""
SELECT market, metric, {r('bartlett', 'bartlett')}, bartlett_df, {r('bartlett_p', 'bartlett_p')}
FROM {_bartlett_rows(_labelled(_RAW_MARKET), 'market, metric')}"""


def _impact(rows: str, keys: str) -> str:
    return f"""
SELECT {keys}, {r('before_mean', 'before_mean')}, {r('after_mean', 'after_mean')},
       {r('t_score', 't_score')}, {r('p_value', 'p_value')}, {r('df', 'df')}
FROM {_t_rows(rows, keys)}"""


def _impact_full(rows: str, keys: str) -> str:
    return f"""
SELECT {keys}, {r('before_mean', 'before_mean')}, {r('after_mean', 'after_mean')},
       {r('t_score', 't_score')}, {r('p_value', 'p_t')}, {r('df', 'df')},
       {r('before_std', 'before_std')}, {r('after_std', 'after_std')}, {r('levene', 'f_score')},
       {r('levene_p', 'p_f')}
FROM {_t_rows(rows, keys)} JOIN {_levene_rows(rows, keys)} USING ({keys})"""


def _variance(rows: str) -> str:
    return f"""
SELECT metric, {r('bartlett', 'bartlett')}, {r('bartlett_p', 'bartlett_p')},
       {r('levene', 'levene')}, {r('levene_p', 'levene_p')}
FROM {_bartlett_rows(rows, 'metric')} JOIN {_levene_rows(rows, 'metric')} USING (metric)"""


_DAILY_TRAVEL = "(" + " UNION ALL ".join(
    f"""SELECT market, '{m}' AS metric, AVG({m}) AS value,
        CASE WHEN visit_date < DATE '2024-01-15' THEN 'before' ELSE 'after' END AS period
        FROM visit_travel GROUP BY market, visit_date"""
    for m in _M
) + ")"
_SQL["experiment_impact_summary"] = _impact(_DAILY_TRAVEL, "market, metric")
_DAILY_STATS = "(" + " UNION ALL ".join(
    f"""SELECT visit_date AS day, market, '{k}_{m}' AS metric, COALESCE({fn}({m}), 0) AS value
        FROM visit_travel WHERE visit_date < DATE '2024-01-31' GROUP BY market, visit_date"""
    for m in _M
    for k, fn in (("min", "MIN"), ("max", "MAX"), ("avg", "AVG"), ("std", "STDDEV_SAMP"))
) + ")"
_SQL["experiment_impact_of_daily_stats"] = f"""
SELECT market, metric, {r('before_mean', 'before')}, {r('after_mean', 'after')},
       {r('t_score', 't_score')}, {r('p_value', 'p_value')}, {r('df', 'df')}
FROM {_t_rows(_labelled(_DAILY_STATS, _NOT_CHANGE_DAY), 'market, metric')}"""
_DAILY_KPIS = (
    "(SELECT visit_date AS day, market, metric, value FROM ("
    + _travel_metrics(False, exact=True)
    + """) UNPIVOT (value FOR metric IN (visit_travel_time, pickup_travel_time,
         pickup_travel_time_per_visit, avg_total_travel_time)))"""
)
_SQL["experiment_impact_of_daily_kpis"] = _impact(
    _labelled(_DAILY_KPIS, _NOT_CHANGE_DAY), "market, metric"
)
_SQL["experiment_impact_around_change"] = _impact(
    _labelled(
        _DAILY_KPIS,
        f"{_NOT_CHANGE_DAY} AND day > DATE '2024-01-05' AND day < DATE '2024-01-25'",
    ),
    "market, metric",
)
_ZONE_SAMPLES = "(SELECT * FROM " + _labelled(
    "(" + " UNION ALL ".join(
        f"SELECT zone, visit_date AS day, '{m}' AS metric, {m} AS value FROM {_ZONED}" for m in _M
    ) + ")"
) + " WHERE period = 'before' OR zone = 'LA-A')"
_SQL["experiment_zone_test"] = _impact_full(_ZONE_SAMPLES, "metric")
_SQL["experiment_zone_test_daily"] = _impact_full(
    f"(SELECT zone, day, period, metric, AVG(value) AS value FROM {_ZONE_SAMPLES} GROUP BY ALL)",
    "metric",
)
_SQL["experiment_impact_summary_full"] = _impact_full(
    _labelled(_RAW_MARKET, _NOT_CHANGE_DAY), "market, metric"
)
_SQL["experiment_impact_summary_pooled"] = _impact_full(_labelled(_RAW, _NOT_CHANGE_DAY), "metric")
_SQL["experiment_variance_summary"] = _variance(_labelled(_RAW))
_SQL["experiment_variance_summary_daily"] = _variance(
    _labelled(f"(SELECT metric, day, AVG(value) AS value FROM {_RAW} GROUP BY metric, day)")
)
_MARKET_T = _t_rows(_labelled(_RAW_MARKET), "market, metric")
_SQL["experiment_unpivot_summary"] = f"""
SELECT market, metric, {r('before_mean', 'before')}, {r('after_mean', 'after')},
       {r('t_score', 't_score')}, {r('p_value', 'p_value')}, {r('df', 'df')} FROM {_MARKET_T}"""
_SQL["experiment_improved"] = f"""
SELECT market, metric, {r('before_mean', 'before_mean')}, {r('after_mean', 'after_mean')},
       {r('t_score', 't_score')}, {r('p_value', 'p_value')}, {r('df', 'df')}
FROM {_MARKET_T} WHERE t_score > 0"""
_SQL["experiment_value_histogram"] = f"""
WITH spans AS (SELECT metric, period, MIN(value) AS lo, MAX(value) AS hi
               FROM {_labelled(_RAW)} GROUP BY metric, period),
bins AS (SELECT *, CAST(unnest(range(1, 29)) AS INTEGER) AS bin FROM spans),
counts AS (SELECT s.metric, s.period,
                  CAST(LEAST(28, 1 + floor(28 * (x.value - s.lo) / (s.hi - s.lo))) AS INTEGER)
                  AS bin, COUNT(*) AS n
           FROM {_labelled(_RAW)} x JOIN spans s ON s.metric = x.metric AND s.period = x.period
           GROUP BY ALL)
SELECT b.metric, b.period, b.bin, {r('b.lo + (b.bin - 1) * (b.hi - b.lo) / 28', 'lower')},
       {r('b.lo + b.bin * (b.hi - b.lo) / 28', 'upper')}, COALESCE(c.n, 0) AS n
FROM bins b LEFT JOIN counts c ON c.metric = b.metric AND c.period = b.period AND c.bin = b.bin"""
_SQL["experiment_distribution_summary"] = " UNION ALL ".join(
    f"""SELECT market, metric, period, CAST({p} AS DOUBLE) AS prob, COUNT(value) AS n,
        {r(f'quantile_cont(value, {p})', 'quantile')}
        FROM {_labelled(_RAW_MARKET)} GROUP BY market, metric, period"""
    for p in (0.0, 0.25, 0.5, 0.75, 1.0)
)
_SQL["experiment_metric_series"] = _SQL["experiment_daily_means"]

ORACLE: dict[str, str] = {name: with_roles(sql).strip() for name, sql in _SQL.items()}
