"""Queries over column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.times import utc_instant
from quayside.operators.profile import compare_profiles, profile
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.tables import describe_columns

# Columns of the driver tables by category, with the SQL type name each one is published under.
_SHAPES = {
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:float "
                "l_extendedprice:float l_discount:float l_tax:float l_returnflag:nvarchar "
                "l_linestatus:nvarchar l_shipdate:datetime2",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:nvarchar o_totalprice:float "
              "o_orderdate:datetime2 o_orderpriority:nvarchar",
    "events": "event_id:bigint ts:datetime2 user_id:bigint event_type:nvarchar value:float props:nvarchar",
}


def _profile_sql(table: str) -> str:
    rows = []
    for i, item in enumerate(_SHAPES[table].split()):
        name, kind = item.split(":")
        low = high = text_low = "NULL"
        mean = deviation = short = longest = mean_length = "NULL"
        category = {"nvarchar": "Text", "datetime2": "Date"}.get(kind, "Number")
        if category == "Number":
            low, high = f"CAST(min({name}) AS VARCHAR)", f"CAST(max({name}) AS VARCHAR)"
            mean, deviation = f"round(avg({name}), 3)", f"round(stddev_samp({name}), 3)"
        elif category == "Date":
            low, high = (f"strftime({f}({name}), '%Y-%m-%dT%H:%M:%S.%f') || '0'" for f in ("min", "max"))
        else:
            short, longest = f"min(length(rtrim({name})))", f"max(length(rtrim({name})))"
            mean_length = f"round(avg(length(rtrim({name}))), 3)"
        rows.append(f"""SELECT {i} AS ordinal, '{name}' AS column_name, '{kind}' AS data_type, '{category}' AS category,
  count(DISTINCT {name}) AS unique_count, count({name}) AS non_null_count,
  CAST({low} AS VARCHAR) AS min_value, CAST({high} AS VARCHAR) AS max_value,
  CAST({mean} AS DOUBLE) AS avg_value, CAST({deviation} AS DOUBLE) AS stddev_value,
  CAST({short} AS INTEGER) AS min_length, CAST({longest} AS INTEGER) AS max_length,
  CAST({mean_length} AS DOUBLE) AS avg_length FROM {table}""")
    return "\nUNION ALL ".join(rows)


def rounded(df: DataFrame) -> DataFrame:
    for name in ("avg_value", "stddev_value", "avg_length"):
        df = df.withColumn(name, F.round(name, 3))
    return df


@query("profile_lineitem", _profile_sql("lineitem"))
def profile_lineitem(portal: Portal) -> DataFrame:
    return rounded(profile(portal.raw("lineitem")))


@query("profile_orders", _profile_sql("orders"))
def profile_orders(portal: Portal) -> DataFrame:
    return rounded(profile(portal.raw("orders")))


@query("profile_events", _profile_sql("events"))
def profile_events(portal: Portal) -> DataFrame:
    return rounded(profile(portal.raw("events")))


@query("profile_approximate_lineitem")
def profile_approximate_lineitem(portal: Portal) -> DataFrame:
    """Distinct counts by HyperLogLog++, all in one aggregation; estimates have no SQL twin."""
    return rounded(profile(portal.raw("lineitem"), distinct="approx"))


@query("profile_boolean_and_section_columns", """
SELECT 0 AS ordinal, 'index_enabled' AS column_name, 'Boolean' AS category, count(DISTINCT index_enabled) AS unique_count,
       count(index_enabled) AS non_null_count FROM sections
UNION ALL SELECT 1, 'index_status', 'Text', count(DISTINCT index_status), count(index_status) FROM sections""", "sections")
def profile_boolean(portal: Portal) -> DataFrame:
    return profile(portal.sections().select("index_enabled", "index_status")).select(
        "ordinal", "column_name", "category", "unique_count", "non_null_count")


@query("profile_compare_orders", """
WITH newer AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice FROM orders)
SELECT 'o_orderkey' AS column_name, count(DISTINCT o.o_orderkey) - count(DISTINCT n.o_orderkey) AS unique_delta,
       count(n.o_orderkey) - count(o.o_orderkey) AS non_null_delta FROM orders o JOIN newer n USING (o_orderkey)
UNION ALL SELECT 'o_totalprice', count(DISTINCT n.o_totalprice) - count(DISTINCT o.o_totalprice),
       count(n.o_totalprice) - count(o.o_totalprice) FROM orders o JOIN newer n USING (o_orderkey)""")
def profile_compare(portal: Portal) -> DataFrame:
    old = portal.raw("orders").select("o_orderkey", "o_totalprice")
    new = portal.raw("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("o_totalprice"))
    return compare_profiles(old, new).select("column_name", "unique_delta", "non_null_delta")


@query("profile_instants", """
SELECT 'o_orderdate' AS column_name, count(DISTINCT o_orderdate) AS unique_count, count(o_orderdate) AS non_null_count,
  strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.%f') || '0' AS min_value,
  strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%f') || '0' AS max_value FROM orders""")
def profile_instants(portal: Portal) -> DataFrame:
    """Instants are shown in UTC, whatever the session zone."""
    rows = portal.raw("orders").select(utc_instant(F.col("o_orderdate")).alias("o_orderdate"))
    return profile(rows).select("column_name", "unique_count", "non_null_count", "min_value", "max_value")


@query("described_columns", """
SELECT * FROM (VALUES (0, 'event_id', 'bigint', 'BigInt', 'Number'), (1, 'ts', 'datetime2', 'DateTime2', 'Date'),
  (2, 'user_id', 'bigint', 'BigInt', 'Number'), (3, 'event_type', 'nvarchar', 'NVarChar', 'Text'),
  (4, 'value', 'float', 'Float', 'Number'), (5, 'props', 'nvarchar', 'NVarChar', 'Text'))
  AS v(ordinal, column_name, data_type, logical_type, category)""")
def described_columns(portal: Portal) -> DataFrame:
    return describe_columns(portal.raw("events"))


@query("approximate_counts_lineitem", "SELECT i AS ordinal, c AS column_name, true AS within_5_percent FROM (VALUES " + ", ".join(
    f"({i}, '{x.split(':')[0]}')" for i, x in enumerate(_SHAPES["lineitem"].split())) + ") AS v(i, c)")
def approximate_counts_lineitem(portal: Portal) -> DataFrame:
    """Estimated distinct counts beside the exact ones."""
    rows = portal.raw("lineitem")
    exact = profile(rows).select("ordinal", "column_name", F.col("unique_count").alias("exact"))
    estimated = profile(rows, distinct="approx", error=0.01).select("ordinal", F.col("unique_count").alias("estimated"))
    near = F.abs(F.col("estimated") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return exact.join(estimated, "ordinal").select("ordinal", "column_name", near.alias("within_5_percent"))
