"""Profiles: shapes, odd values and the estimated form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators.profile import FIELDS, compare_profiles, profile


def test_every_category(spark):
    rows = spark.createDataFrame(
        [(1, "a  ", True, 1.5, bytearray(b"x")), (2, None, None, None, None), (None, "bcd", False, 2.5, bytearray(b"x"))],
        "n int, t string, b boolean, f double, x binary").withColumn("d", F.lit("2024-01-02").cast("date")).withColumn(
        "ts", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    found = {r["column_name"]: r for r in profile(rows).collect()}
    assert list(found) and list(profile(rows).columns) == ["ordinal", *FIELDS]
    assert [found["n"][c] for c in FIELDS[1:9]] == ["int", "Number", 2, 2, "1", "2", 1.5, 0.5 ** 0.5]
    assert [found["t"][c] for c in ("category", "unique_count", "min_value", "min_length", "max_length", "avg_length")] == [
        "Text", 2, None, 1, 3, 2.0]
    assert [found["b"][c] for c in ("category", "unique_count", "non_null_count", "min_value")] == ["Boolean", 2, 2, None]
    assert [found["x"][c] for c in ("category", "unique_count", "non_null_count")] == ["Other", 1, 2]
    assert found["d"]["min_value"] == "2024-01-02" and found["ts"]["max_value"] == "2024-01-02T03:04:05.0000000"


def test_empty_table(spark):
    found = profile(spark.createDataFrame([], "n int, t string")).collect()
    assert [(r["unique_count"], r["non_null_count"], r["min_value"], r["min_length"]) for r in found] == [(0, 0, None, None)] * 2


def test_estimates_are_close(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    exact = {r["column_name"]: r for r in profile(rows).collect()}
    for row in profile(rows, distinct="approx").collect():
        wanted = exact[row["column_name"]]
        assert abs(row["unique_count"] - wanted["unique_count"]) <= max(2, 0.2 * wanted["unique_count"])
        assert row["non_null_count"] == wanted["non_null_count"] and row["max_value"] == wanted["max_value"]


def test_columns_can_be_chosen(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    assert [r["column_name"] for r in profile(rows, ["o_totalprice", "o_custkey"]).orderBy("ordinal").collect()] == [
        "o_custkey", "o_totalprice"]


def test_compare_shows_new_and_lost_columns(spark):
    old, new = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2), (3, 4)], "A int, c int")
    found = {r["column_name"]: r for r in compare_profiles(old, new).collect()}
    assert set(found) == {"a", "b", "c"} and found["a"]["unique_delta"] == 1 and found["b"]["new_unique_count"] is None
