"""Slices, keyset pages, cursors and the clustered layout."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.errors import RequestError
from quayside.functions.literals import cursor_encode
from quayside.operators.slices import (
    IndexColumns, after_cursor, clustered, default_index_name, id_slice, include_slice, keyset_page, page_bound,
    page_info, scan_pages, slice_rows, time_slice, write_clustered, zone_map)
from quayside.sources.pages import write_page_parquet

INDEX = IndexColumns(time="ts", key="event_id", id="user_id", include="value")


@pytest.fixture(scope="module")
def events(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet")


def test_request_errors(events):
    with pytest.raises(RequestError, match="after its end"):
        time_slice(events, "ts", "2024-02-01", "2024-01-01")
    with pytest.raises(RequestError, match="id column"):
        id_slice(events, None, "7")
    with pytest.raises(RequestError, match="64-bit"):
        id_slice(events, "user_id", "x")
    for limit in (0, 100_001, None):
        with pytest.raises(RequestError):
            keyset_page(events, ["event_id"], limit)


@pytest.mark.parametrize("with_include", [False, True])
def test_pages_make_up_the_slice(events, with_include):
    """Repeated ids and NULL keys neither lose nor repeat a row."""
    rows = events.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.lit(3))).withColumn(
        "ts", F.when(F.col("event_id") % 7 != 0, F.date_trunc("day", "ts").cast("timestamp_ntz")))
    if with_include:
        rows = include_slice(rows, INDEX, with_key=True)
    keys = INDEX.order(with_include)
    found = [tuple(r) for page in scan_pages(rows, keys, 230) for r in page.collect()]
    wanted = [tuple(r) for r in rows.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).collect()]
    assert found == wanted and len(found) == rows.count()


def test_page_info_at_the_end(events):
    n = events.count()
    info = page_info(events, ["event_id"], n)
    assert (info.row_count, info.has_more, info.next_cursor) == (n, False, "")
    last = cursor_encode([events.agg(F.max("event_id")).head()[0]])
    assert page_info(events, ["event_id"], 10, last).row_count == 0


values = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 3))))
def test_after_cursor_is_tuple_order(spark, pairs, cursor):
    rows = spark.createDataFrame(pairs, "a int, b int")
    low = lambda v: (v is not None, v or 0)
    wanted = sorted(p for p in map(lambda p: (low(p[0]), low(p[1])), pairs) if p > (low(cursor[0]), low(cursor[1])))
    found = sorted((low(r["a"]), low(r["b"])) for r in after_cursor(rows, ["a", "b"], list(cursor)).collect())
    assert found == wanted


def test_layout_spreads_a_hot_id(spark, events, tmp_path):
    hot = events.withColumn("user_id", F.lit(1).cast("bigint"))
    sizes = [r["n"] for r in clustered(hot, INDEX, 8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < events.count() / 3


def test_bound_keeps_the_page(spark, events, tmp_path):
    path = str(tmp_path / "clustered")
    write_clustered(events, INDEX, path, 12)
    rows = spark.read.parquet(path)
    zones = zone_map(rows, INDEX)
    keys = INDEX.order()
    bound = page_bound(zones, INDEX, 50)
    assert bound is not None
    assert keyset_page(rows, keys, 50, None, bound).collect() == keyset_page(rows, keys, 50).collect()
    sliced = slice_rows(rows, INDEX, "2024-01-10", None)
    bound = page_bound(zones, INDEX, 20, start="2024-01-10 00:00:00")
    assert keyset_page(sliced, keys, 20, None, bound).collect() == keyset_page(sliced, keys, 20).collect()
    assert page_bound(zones, INDEX, 100_000) is None


def test_written_page(spark, events, tmp_path):
    page = keyset_page(events, ["event_id"], 300)
    assert write_page_parquet(page, str(tmp_path / "page"), 100) > 0
    assert spark.read.parquet(str(tmp_path / "page")).count() == 300
    with pytest.raises(RequestError, match="size limit"):
        write_page_parquet(page, str(tmp_path / "small"), 100, max_bytes=10)


def test_index_names():
    assert default_index_name("T", "id") == "IX_T_id_time" and default_index_name("T", None) == "IX_T_time"
