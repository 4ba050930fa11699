"""Series as SQL, matching the frames of sources.tables."""

from __future__ import annotations


def events_cte(by: str = "event_type") -> str:
    return f"""s AS (
  SELECT CAST({by} AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) - 1 AS t, ts,
         value AS x, CAST(round(value * 100) AS BIGINT) AS x_fp FROM events
)"""


EVENTS = events_cte()
USERS = events_cte("user_id")
GAPS = EVENTS + """, g AS (
  SELECT series_id, t, ts, CASE WHEN t % 17 = 3 THEN NULL ELSE x END AS x, CASE WHEN t % 17 = 3 THEN NULL ELSE x_fp END AS x_fp FROM s
)"""
BLOCKS = EVENTS + """, g AS (
  SELECT series_id, t, ts, CASE WHEN t BETWEEN 40 AND 59 THEN NULL ELSE x END AS x FROM s
)"""
ERRORS = """s AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS x_fp FROM events
)"""
ORDERS = """s AS (
  SELECT 'orders' AS series_id, row_number() OVER (ORDER BY day) - 1 AS t, day AS ts, n AS x_fp
  FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
)"""
LINEITEM = """s AS (
  SELECT 'lineitem' AS series_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_quantity) - 1 AS t, l_shipdate AS ts, l_quantity AS x, CAST(round(l_quantity * 100) AS BIGINT) AS x_fp FROM lineitem
)"""
#: Segments of about 50 rows for cost queries.
SEGS = """, seg AS (
  SELECT series_id, t // 50 AS k, min(t) AS s, max(t) + 1 AS e, count(*) AS m FROM s GROUP BY 1, 2
)"""
