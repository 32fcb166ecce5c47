"""The roles of ``fieldkpi.sources.star_roles`` as plain SQL, for checking."""

from __future__ import annotations

import re

_CREATED = """TIMESTAMP '2024-01-01 00:00:00' + to_seconds(
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 * 86400
    + CAST(floor(o_totalprice) AS BIGINT) % 86400)"""

_ITEM = """(l_orderkey * 8 + l_linenumber) * 1000003
               + (l_partkey * 1009 + l_suppkey) % 1000003"""

ROLES: dict[str, str] = {
    "centers": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS market,
               CASE r_regionkey WHEN 0 THEN 'Africa/Johannesburg' WHEN 1 THEN 'America/Los_Angeles'
                    WHEN 2 THEN 'Asia/Kolkata' WHEN 3 THEN 'Europe/Berlin' ELSE 'Asia/Dubai' END
               AS time_zone,
               concat_ws('-', CAST(n_nationkey AS VARCHAR), r_name) AS label
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "experts": """
        SELECT c_custkey AS expert_id,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Trainer' ELSE 'Expert' END AS expert_type,
               split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
               replace(c_name, '#', ' ') AS full_name,
               CAST(c_nationkey AS BIGINT) AS house_id,
               'NATION_' || c_nationkey AS house_name,
               'NATION_' || ((c_nationkey + 7) % 25) AS home_name
        FROM customer""",
    "homes": """
        SELECT x.expert_id, c.label AS market, c.market AS center_market, c.time_zone
        FROM experts x JOIN centers c ON x.house_id = c.id""",
    "blocks": """
        SELECT event_id AS id, event_id // 5 AS event_id,
               CASE event_type WHEN 'view' THEN 'InventoryTransfer' WHEN 'click' THEN 'TravelTime'
                    WHEN 'purchase' THEN 'Visit' WHEN 'signup' THEN 'PaidTimeOff'
                    ELSE 'Meeting' END AS event_type,
               ts AS start_time, ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS end_time,
               value >= 2 AS enabled
        FROM events""",
    "sched": """
        SELECT event_id AS calendar_block_id, user_id AS expert_id,
               user_id * 1000 + dayofyear(ts) AS shift_id FROM events""",
    "shifts": """
        SELECT user_id * 1000 + dayofyear(d) AS id, user_id AS expert_id,
               CAST(d AS TIMESTAMP) + to_hours(user_id % 24) AS start_time,
               CAST(d AS TIMESTAMP) + to_hours(user_id % 24)
               + to_minutes((user_id * 7 + dayofyear(d)) % 16 * 60 + user_id * 11 % 60) AS end_time,
               (user_id + dayofyear(d)) % 10 <> 0 AS enabled
        FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)""",
    "transfers": f"""
        SELECT o_orderkey AS id, o_custkey AS expert_id, o_orderkey AS travel_time_id,
               o_custkey // 30 AS inventory_location_id, o_custkey AS meeting_address_id,
               {_CREATED} AS created_at
        FROM orders""",
    "bridge": f"""
        SELECT {_ITEM} AS id, l_orderkey + l_linenumber // 4 AS transfer_id, {_ITEM} AS item_id
        FROM lineitem""",
    "items": f"""
        SELECT {_ITEM} AS id, l_orderkey AS order_id,
               CAST(l_partkey AS VARCHAR) AS sku
        FROM lineitem""",
    "order_master": f"""
        SELECT order_id, expert_id, order_status, CAST(created AS DATE) AS created_date,
               created, CAST(created - INTERVAL 8 HOUR AS DATE) AS created_date_pt,
               CASE WHEN order_status <> 'complete'
                    THEN created + to_seconds(price % 50000) END AS canceled_at,
               channel, partner_id,
               CASE WHEN order_status <> 'scheduled' THEN order_id END AS visit_id,
               CAST(created AS DATE) + 1 AS visit_date, 'NATION_' || (expert_id % 25) AS visit_eh
        FROM (SELECT o_orderkey AS order_id, o_custkey AS expert_id, {_CREATED} AS created,
                     CASE o_orderstatus WHEN 'F' THEN 'canceled' WHEN 'O' THEN 'complete'
                          ELSE 'scheduled' END AS order_status,
                     CAST(floor(o_totalprice) AS BIGINT) AS price,
                     CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Integration'
                          ELSE 'Direct' END AS channel,
                     CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS partner_id
              FROM orders)""",
    "visits": """
        SELECT event_id AS id, event_id // 5 AS order_id, user_id AS expert_id,
               event_id // 5 AS travel_time_id, user_id AS meeting_address_id,
               CASE WHEN value < 20 THEN 'Employee' WHEN value < 60 THEN 'Customer'
                    ELSE 'Unknown' END AS actor,
               CASE event_type WHEN 'error' THEN 'canceled' WHEN 'purchase' THEN 'complete'
                    ELSE 'scheduled' END AS status,
               ts - INTERVAL 6 HOUR AS created, CAST(ts - INTERVAL 6 HOUR AS DATE) AS created_date,
               ts - INTERVAL 6 HOUR + to_seconds(CAST(round(value * 600) AS BIGINT)) AS updated,
               CAST(ts AS DATE) AS start_date,
               CAST(ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS DATE) AS end_date
        FROM events WHERE event_type IN ('error', 'purchase', 'signup')""",
    "profile_changes": """
        SELECT c_custkey AS expert_id, CAST(c_nationkey AS BIGINT) AS center_id,
               DATE '2023-12-01' AS first_day, DATE '2024-01-01' + CAST(c_custkey % 30 AS INT)
               AS last_day
        FROM customer
        UNION ALL
        SELECT c_custkey, CAST((c_nationkey + 1) % 25 AS BIGINT),
               DATE '2024-01-02' + CAST(c_custkey % 30 AS INT), DATE '2024-12-31'
        FROM customer""",
    "badges": """
        SELECT CAST(r_regionkey AS BIGINT) AS id,
               CASE r_regionkey WHEN 0 THEN 'OPUS Ability' WHEN 1 THEN 'Sonos Ability'
                    ELSE r_name END AS name
        FROM region""",
    "expert_badges": """
        SELECT c_custkey AS expert_id, unnest([c_custkey % 5, (c_custkey + 1) % 5]) AS badge_id,
               TIMESTAMP '2024-01-01 03:00:00' + to_days(CAST(c_custkey % 20 AS INT)) AS date_added
        FROM customer""",
    "fiscal_dates": """
        SELECT d AS fiscal_date, d + CAST(7 - isodow(d) AS INT) AS week_end,
               CAST(weekofyear(d) - weekofyear(DATE '2024-01-31') AS INT) AS week_offset,
               CAST(date_diff('day', DATE '2024-01-31', d) AS INT) AS day_offset
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""",
    "planned": """
        SELECT 'NATION_' || c_nationkey AS ec_name, COUNT(*) AS experts_lms
        FROM customer GROUP BY c_nationkey""",
    "travel_times": """
        SELECT center_market AS market, CAST(ts AS DATE) AS day, value AS visit_minutes,
               CASE WHEN value >= 5 THEN value / 3 END AS pickup_minutes
        FROM events JOIN homes ON user_id = expert_id WHERE event_type = 'click'""",
    "addresses": """
        SELECT c_custkey AS id, lpad(CAST(c_custkey // 15 AS VARCHAR), 5, '0') AS zip
        FROM customer""",
    "zips": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip, 'NATION_' || s_nationkey AS market,
               CAST(s_nationkey AS BIGINT) AS area_id,
               CAST(floor(greatest(s_acctbal, 0) * 10) AS BIGINT) AS population,
               CAST(CAST(floor(greatest(s_acctbal, 0)) AS BIGINT) % 97 AS DOUBLE) AS land,
               CASE WHEN s_suppkey % 2 = 0 THEN 'LA-A' ELSE 'LA-B' END AS zone
        FROM supplier""",
    "areas": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST((n_nationkey + 3) % 25 AS BIGINT) AS center_id
        FROM nation""",
    # Steps that several checks share.
    "located": """
        SELECT b.event_id, s.expert_id, h.market, h.center_market, b.event_type,
               CAST(b.start_time AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS event_date,
               CAST(date_diff('microsecond', b.start_time, b.end_time) AS DOUBLE) / 6e7 AS minutes
        FROM blocks b JOIN sched s ON b.id = s.calendar_block_id
        JOIN homes h ON s.expert_id = h.expert_id
        WHERE b.enabled""",
    "units": """
        SELECT t.id AS transfer_id, COUNT(b.id) AS n_units
        FROM transfers t LEFT JOIN bridge b ON t.id = b.transfer_id GROUP BY t.id""",
    "item_moves": """
        SELECT i.order_id, i.sku, b.transfer_id, t.travel_time_id, t.expert_id,
               t.meeting_address_id, CAST(t.created_at AS DATE) AS created_date
        FROM items i JOIN bridge b ON b.item_id = i.id JOIN transfers t ON t.id = b.transfer_id""",
    "trips": """
        SELECT b.event_id, s.expert_id, b.start_time,
               CAST(date_diff('microsecond', b.start_time, b.end_time) AS DOUBLE) / 6e7 AS minutes
        FROM blocks b JOIN sched s ON b.id = s.calendar_block_id
        WHERE b.event_type = 'TravelTime' AND b.enabled""",
    "pickup_trips": """
        SELECT n.transfer_id, p.expert_id, p.start_time, p.minutes AS ptt,
               p.minutes / n.n_visits AS pttpv
        FROM (SELECT m.transfer_id, m.travel_time_id, COUNT(v.id) AS n_visits
              FROM item_moves m JOIN visits v ON v.order_id = m.order_id
              GROUP BY m.transfer_id, m.travel_time_id) n
        JOIN trips p ON p.event_id = n.travel_time_id""",
    "travel_rows": """
        SELECT v.id AS visit_id, v.order_id, v.meeting_address_id, m.sku, h.market,
               CAST(o.start_time AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS visit_date,
               o.minutes AS vtt, p.ptt, p.pttpv, o.minutes + p.pttpv AS ttt
        FROM visits v JOIN item_moves m ON m.order_id = v.order_id
        JOIN trips o ON o.event_id = v.travel_time_id
        JOIN pickup_trips p ON p.transfer_id = m.transfer_id
        JOIN homes h ON h.expert_id = v.expert_id""",
    "visit_travel": """
        SELECT DISTINCT visit_id, visit_date, market, vtt, ptt, pttpv, ttt FROM travel_rows""",
    "placed_orders": """
        SELECT o.*, h.market,
               CAST(o.canceled_at AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE)
               AS canceled_date
        FROM order_master o JOIN homes h ON o.expert_id = h.expert_id""",
    "placed_visits": """
        SELECT v.*, o.order_status, o.created_date AS order_date, o.created AS order_created,
               h.market,
               CAST(v.updated AT TIME ZONE 'UTC' AT TIME ZONE h.time_zone AS DATE) AS updated_date
        FROM visits v JOIN order_master o ON v.order_id = o.order_id
        JOIN homes h ON v.expert_id = h.expert_id""",
    "samples": """
        SELECT event_type AS metric, value, user_id % 2 AS arm, CAST(ts AS DATE) AS day,
               CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS period
        FROM events""",
}


def with_roles(sql: str) -> str:
    """``sql`` preceded by the role definitions it needs, directly or through others."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in ROLES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(ROLES[name])
    parts = [f"{name} AS ({ROLES[name]})" for name in ROLES if name in needed]
    if not parts:
        return sql
    tail = sql.lstrip()
    joined = ",\n".join(parts)
    if tail.upper().startswith("WITH "):
        return f"WITH {joined},\n{tail[5:]}"
    return f"WITH {joined}\n{tail}"
