"""Queries over exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.render import render_all
from quayside.operators.rowindex import scan_row_index
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.export import export_csv_parts, manifest_parts, manifest_totals, number_parts, render_warnings
from quayside.storage import fresh_path

ROWS_PER_PART = 3_000
ORDER = ["event_id"]

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '0Z'"
_EVENT_TEXT = f"""CAST(event_id AS VARCHAR) AS event_id, {_ISO.format('ts')} AS ts, CAST(user_id AS VARCHAR) AS user_id,
  event_type, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS value, props"""


@query("export_rendered_events", f"SELECT {_EVENT_TEXT} FROM events")
def export_rendered_events(portal: Portal) -> DataFrame:
    return render_all(portal.raw("events"))


@query("export_rendered_orders", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even,
  {_ISO.format('o_orderdate')} AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') END AS price,
  CAST(CAST(o_orderkey AS DECIMAL(18, 4)) AS VARCHAR) AS exact, base64(encode(o_orderpriority)) AS bytes FROM orders""")
def export_rendered_orders(portal: Portal) -> DataFrame:
    key = F.col("o_orderkey")
    return render_all(portal.raw("orders").select(
        key, (key % 2 == 0).alias("even"), "o_orderdate", F.col("o_orderdate").cast("date").alias("day"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"), key.cast("decimal(18,4)").alias("exact"),
        F.encode("o_orderpriority", "utf-8").alias("bytes")))


@query("export_parts_events", f"""
WITH n AS (SELECT count(*) AS rows FROM events), p AS (
  SELECT CAST(unnest(generate_series(1, CAST(ceil(rows / {ROWS_PER_PART}.0) AS BIGINT))) AS INTEGER) AS part_number, rows FROM n)
SELECT 'data_part' || lpad(CAST(part_number AS VARCHAR), 3, '0') || '.csv' AS file, part_number,
  least({ROWS_PER_PART}, rows - (part_number - 1) * {ROWS_PER_PART}) AS row_count,
  CAST((part_number - 1) * {ROWS_PER_PART} + 1 AS BIGINT) AS first_row_index,
  least(part_number * {ROWS_PER_PART}, rows) AS last_row_index FROM p""")
def export_parts_events(portal: Portal) -> DataFrame:
    return manifest_parts(number_parts(portal.raw("events"), ROWS_PER_PART, ORDER))


@query("export_totals_lineitem", "SELECT count(*) AS total_row_count, CAST(ceil(count(*) / 7000.0) AS BIGINT) AS parts FROM lineitem")
def export_totals_lineitem(portal: Portal) -> DataFrame:
    """Parts in the order the table is stored in: nothing is sorted."""
    return manifest_totals(number_parts(portal.raw("lineitem"), 7_000, scan=True))


@query("export_csv_events", f"""
SELECT {_EVENT_TEXT}, CAST(floor((row_number() OVER (ORDER BY events.event_id) - 1) / {ROWS_PER_PART}) AS INTEGER) + 1 AS part FROM events""")
def export_csv_events(portal: Portal) -> DataFrame:
    """Written parts read back as text: one header per part, quotes and commas intact."""
    rows = portal.raw("events")
    path = fresh_path(portal.spark, "export")
    export_csv_parts(rows, path, ROWS_PER_PART, ORDER)
    text = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns] + [T.StructField("part", T.IntegerType())])
    return portal.spark.read.schema(text).options(header=True, quote='"', escape='"').option(
        "pathGlobFilter", "*.csv").csv(path)


@query("export_csv_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS text FROM documents")
def export_csv_documents(portal: Portal) -> DataFrame:
    """Texts with line breaks, quotes and every other sign survive the export whole."""
    path = fresh_path(portal.spark, "export")
    export_csv_parts(portal.raw("documents").select("doc_id", "text"), path, 200)
    text = "doc_id string, text string, part int"
    return portal.spark.read.schema(text).options(
        header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        maxCharsPerColumn=-1).option("pathGlobFilter", "*.csv").csv(path).select("doc_id", F.sha2("text", 256).alias("text"))


@query("scan_index_orders", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS first_row, count(*) AS last_row, count(*) AS distinct_rows FROM orders")
def scan_index_orders(portal: Portal) -> DataFrame:
    """The index in stored order is dense, whatever the order of the files is."""
    return scan_row_index(portal.raw("orders")).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"),
        F.count_distinct("row_index").alias("distinct_rows"))


@query("export_warnings", """
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS row_index FROM lineitem)
SELECT row_index, 'l_quantity' AS column_name, 'Infinity' AS value, 'the value is not a finite number' AS message FROM numbered WHERE l_orderkey % 97 = 0
UNION ALL SELECT row_index, 'l_tax', 'NaN', 'the value is not a finite number' FROM numbered WHERE l_linenumber = 7
""")
def export_warnings(portal: Portal) -> DataFrame:
    """Cells of an export that are no finite numbers, with their row."""
    rows = portal.raw("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))
    return render_warnings(number_parts(rows, 10_000, ["l_orderkey", "l_linenumber"]))
