"""Queries over slices and keyset pages of the event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.literals import cursor_encode
from quayside.operators.slices import (
    IndexColumns, all_pages, id_slice, include_slice, keyset_page, page_bound, page_info_frame,
    project_distinct_columns, slice_rows, time_slice, write_clustered, zone_map)
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.pages import write_page_parquet
from quayside.sources.tables import preview
from quayside.storage import fresh_path

INDEX = IndexColumns(time="ts", key="event_id", id="user_id", include="value")
START, END = "2024-01-05T00:00:00Z", "2024-01-20 12:00:00"
_WITHIN = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"


@query("preview_events", """
SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(event_type, '') AS event_type,
       coalesce(props, '') AS props, CASE WHEN event_id % 2 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id
FROM events ORDER BY events.event_id LIMIT 10""")
def preview_events(portal: Portal) -> DataFrame:
    rows = portal.raw("events").select(
        "event_id", "event_type", "props", F.when(F.col("event_id") % 2 != 0, F.col("user_id")).alias("user_id"))
    return preview(rows, ["event_id"])


@query("time_slice_events", f"SELECT * FROM events WHERE {_WITHIN}")
def time_slice_events(portal: Portal) -> DataFrame:
    return time_slice(portal.raw("events"), "ts", START, END)


@query("id_slice_events", "SELECT * FROM events WHERE user_id = 7")
def id_slice_events(portal: Portal) -> DataFrame:
    return id_slice(portal.raw("events"), "user_id", "7")


@query("slice_events", f"SELECT * FROM events WHERE user_id = 7 AND {_WITHIN}")
def slice_events(portal: Portal) -> DataFrame:
    return slice_rows(portal.raw("events"), INDEX, START, END, "7")


@query("include_slice_events", """
SELECT user_id, ts, value FROM events WHERE value = 12.31 AND ts >= TIMESTAMP '2024-01-01 00:00:00'""")
def include_slice_events(portal: Portal) -> DataFrame:
    return include_slice(portal.raw("events"), INDEX, "12.31", "1/1/2024")


@query("project_columns_orders", "SELECT o_orderkey, o_totalprice FROM orders")
def project_columns_orders(portal: Portal) -> DataFrame:
    return project_distinct_columns(portal.raw("orders"), ["o_orderkey", " ", None, "o_totalprice", "o_orderkey"])


@query("keyset_page_first", "SELECT * FROM events ORDER BY event_id LIMIT 1000")
def keyset_page_first(portal: Portal) -> DataFrame:
    return keyset_page(portal.raw("events"), ["event_id"], 1000)


@query("keyset_page_next", "SELECT * FROM events WHERE event_id > 1234 ORDER BY event_id LIMIT 1000")
def keyset_page_next(portal: Portal) -> DataFrame:
    return keyset_page(portal.raw("events"), ["event_id"], 1000, cursor_encode([1234]))


@query("keyset_page_two_keys", """
SELECT * FROM lineitem
WHERE l_orderkey > 500 OR (l_orderkey = 500 AND (l_linenumber > 2 OR (l_linenumber = 2 AND l_partkey > 100)))
ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 500""")
def keyset_page_two_keys(portal: Portal) -> DataFrame:
    return keyset_page(portal.raw("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], 500,
                       cursor_encode([500, 2, 100]))


@query("keyset_page_info", """
WITH head AS (SELECT event_id FROM events WHERE event_id > 99 ORDER BY event_id LIMIT 1001),
     page AS (SELECT event_id FROM head ORDER BY event_id LIMIT 1000)
SELECT CAST((SELECT count(*) FROM page) AS INTEGER) AS row_count, (SELECT count(*) FROM head) > 1000 AS has_more,
       (SELECT max(event_id) FROM page) AS last_event_id""")
def keyset_page_info(portal: Portal) -> DataFrame:
    return page_info_frame(portal.raw("events"), ["event_id"], 1000, cursor_encode([99]))


@query("slice_page_events", f"""
SELECT * FROM events WHERE {_WITHIN}
  AND (user_id > 7 OR (user_id = 7 AND ts > TIMESTAMP '2024-01-10 00:00:00')
       OR (user_id = 7 AND ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > 0))
ORDER BY user_id, ts, event_id LIMIT 300""")
def slice_page_events(portal: Portal) -> DataFrame:
    rows = slice_rows(portal.raw("events"), INDEX, START, END)
    return keyset_page(rows, INDEX.order(), 300, cursor_encode([7, dt.datetime(2024, 1, 10), 0]))


@query("include_page_events", """
SELECT user_id, ts, value, event_id FROM events WHERE value >= 0 AND event_type IS NOT NULL
ORDER BY user_id, ts, value, event_id LIMIT 250""")
def include_page_events(portal: Portal) -> DataFrame:
    rows = include_slice(portal.raw("events"), INDEX, with_key=True)
    return keyset_page(rows, INDEX.order(with_include=True), 250)


@query("full_scan_events", "SELECT event_id, user_id, value FROM events")
def full_scan_events(portal: Portal) -> DataFrame:
    """The whole table in one read: what a client assembles from pages."""
    return portal.raw("events").select("event_id", "user_id", "value")


@query("full_scan_by_pages", """
SELECT event_id, user_id, value, CAST(floor((row_number() OVER (ORDER BY user_id, ts, event_id) - 1) / 700) AS INTEGER) + 1 AS page FROM events""")
def full_scan_by_pages(portal: Portal) -> DataFrame:
    """All pages of the table at once, each row with its page."""
    rows = portal.raw("events").select("event_id", "user_id", "value", "ts")
    return all_pages(rows, INDEX.order(), 700).drop("ts")


def clustered_events(portal: Portal) -> DataFrame:
    path = fresh_path(portal.spark, "events-clustered")
    write_clustered(portal.raw("events"), INDEX, path, partitions=16)
    return portal.spark.read.parquet(path)


@query("clustered_layout_events", "SELECT * FROM events")
def clustered_layout_events(portal: Portal) -> DataFrame:
    """Written in (id, time, key) order: the same rows in files with narrow ranges."""
    return clustered_events(portal)


@query("zone_map_events", """
SELECT count(*) AS total, min(user_id) AS low, max(user_id) AS high, min(ts) AS first_at, max(ts) AS last_at FROM events""")
def zone_map_events(portal: Portal) -> DataFrame:
    zones = zone_map(clustered_events(portal), INDEX)
    return zones.agg(F.sum("n").alias("total"), F.min("min_user_id").alias("low"), F.max("max_user_id").alias("high"),
                     F.min("min_ts").alias("first_at"), F.max("max_ts").alias("last_at"))


@query("bounded_page_events", """
SELECT * FROM events WHERE user_id > 20 OR (user_id = 20 AND (ts > TIMESTAMP '2024-01-10 00:00:00'
  OR (ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > 0)))
ORDER BY user_id, ts, event_id LIMIT 400""")
def bounded_page_events(portal: Portal) -> DataFrame:
    """A page over the clustered layout that reads only files up to a proven bound."""
    rows = clustered_events(portal)
    bound = page_bound(zone_map(rows, INDEX), INDEX, 400, cursor_first=20)
    return keyset_page(rows, INDEX.order(), 400, cursor_encode([20, dt.datetime(2024, 1, 10), 0]), bound)


@query("write_page_events", "SELECT * FROM events ORDER BY event_id LIMIT 5000")
def write_page_events(portal: Portal) -> DataFrame:
    path = fresh_path(portal.spark, "page")
    write_page_parquet(keyset_page(portal.raw("events"), ["event_id"], 5000), path, rows_per_group=1000)
    return portal.spark.read.parquet(path)
