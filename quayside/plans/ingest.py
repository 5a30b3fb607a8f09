"""Queries over typed ingest: inference, conversion, rejects, keys, loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside import types as L
from quayside.operators.convert import convert, drop_empty_rows, import_errors, import_result
from quayside.operators.headers import align_by_name, duplicate_headers
from quayside.operators.infer import apply_overrides, index_column_candidates, infer_columns, inference_report
from quayside.functions.text import staged_name_column
from quayside.operators.load import load_table
from quayside.operators.profile import profile
from quayside.operators.rowindex import add_surrogate_key, row_index
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.tables import content_hashes
from quayside.sources.tabular import FILE, FILE_SEQ, ROW_NO, read_csv, read_tabular
from quayside.storage import fresh_path

ROW_KEY = "event_id"
COLUMNS = [
    L.ColumnDef("flag", L.BIT), L.ColumnDef("count", L.INT), L.ColumnDef("total", L.BIG_INT),
    L.ColumnDef("price", L.DECIMAL), L.ColumnDef("ratio", L.FLOAT), L.ColumnDef("seen", L.DATE_TIME),
    L.ColumnDef("note", L.TEXT, 255),
]
NAMES = [c.name for c in COLUMNS]


def raw_cells(portal: Portal) -> DataFrame:
    """``events`` as text cells, one column per logical type, with damaged cells by key."""
    key = F.col(ROW_KEY)
    cents = F.floor(F.col("value") * 100).cast("bigint")
    whole, rest = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    amount = F.concat(whole.cast("string"), F.lit("."), rest)
    cells = [
        key,
        F.when(key % 11 == 0, F.lit("maybe")).when(key % 5 == 0, F.lit(" YES ")).when(key % 5 == 1, F.lit("0"))
        .when(key % 5 == 2, F.lit("False")).when(key % 5 == 3, F.lit("")).otherwise(F.lit("1")).alias("flag"),
        F.when(key % 13 == 0, F.lit("x1")).when(key % 13 == 1, F.concat(whole.cast("string"), F.lit(".0")))
        .when(key % 13 == 2, F.lit("   ")).when(key % 13 == 3, F.lit("3000000000"))
        .when(key % 13 == 4, F.concat(F.lit(" +"), whole.cast("string"), F.lit(" ")))
        .otherwise(whole.cast("string")).alias("count"),
        F.when(key % 17 == 0, F.lit("1e3")).otherwise(
            F.concat(F.lit("-"), (key + 10000000000).cast("string"))).alias("total"),
        F.when(key % 7 == 0, F.concat(F.lit("("), amount, F.lit(")")))
        .when(key % 7 == 1, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5")))
        .when(key % 7 == 2, F.concat(F.lit("¤"), amount)).when(key % 7 == 3, F.concat(amount, F.lit("-")))
        .when(key % 7 == 4, F.concat(whole.cast("string"), F.lit("e2"))).when(key % 7 == 5, F.lit("--5"))
        .otherwise(amount).alias("price"),
        F.when(key % 19 == 0, F.lit("1d")).when(key % 19 == 1, F.concat(F.lit("."), rest))
        .otherwise(F.concat(amount, F.lit("E1"))).alias("ratio"),
        F.when(key % 6 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(key % 6 == 1, F.date_format("ts", "M/d/yyyy")).when(key % 6 == 2, F.date_format("ts", "yyyy/MM/dd"))
        .when(key % 6 == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(key % 6 == 4, F.lit("2024")).otherwise(F.lit("2024-02-30")).alias("seen"),
        F.when(key % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(' "a", '), "event_type", F.lit("\n; "))).alias("note"),
    ]
    # Some rows hold nothing, some nothing that can be converted.
    def damaged(cell: str):
        return F.when(key % 23 == 0, F.lit(" ")).when(key % 23 == 1, F.lit("?")).otherwise(F.col(cell)).alias(cell)

    return portal.raw("events").select(*cells).select(
        key, *[damaged(c) for c in NAMES[:-1]],
        F.when(key % 23 <= 1, F.lit(" ")).otherwise(F.col("note")).alias("note"))


# What each cell must become, computed from the numbers and times themselves.
EXPECTED_SQL = """
base AS (
  SELECT event_id AS k, ts, event_type, CAST(floor(value * 100) AS BIGINT) AS cents, event_id % 23 <= 1 AS bad
  FROM events),
expected AS (
  SELECT k, bad,
    CASE WHEN bad OR k % 11 = 0 THEN NULL WHEN k % 5 IN (0, 4) THEN true WHEN k % 5 IN (1, 2) THEN false END AS flag,
    CASE WHEN bad OR k % 13 <= 3 THEN NULL ELSE CAST(cents // 100 AS INTEGER) END AS "count",
    CASE WHEN bad OR k % 17 = 0 THEN NULL ELSE -(k + 10000000000) END AS total,
    CASE WHEN bad OR k % 7 = 5 THEN NULL WHEN k % 7 IN (0, 3) THEN -cents / 100.0
         WHEN k % 7 = 1 THEN 1000 + k % 1000 + 0.5 WHEN k % 7 = 4 THEN (cents // 100) * 100.0
         ELSE cents / 100.0 END AS price,
    CASE WHEN bad OR k % 19 = 0 THEN NULL WHEN k % 19 = 1 THEN (cents % 100) / 100.0
         ELSE cents / 10.0 END AS ratio,
    CASE WHEN bad THEN NULL WHEN k % 6 = 0 THEN date_trunc('second', ts)
         WHEN k % 6 IN (1, 2) THEN date_trunc('day', ts)
         WHEN k % 6 = 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS seen,
    CASE WHEN bad OR k % 3 = 0 THEN NULL ELSE '"a", ' || event_type || chr(10) || ';' END AS note
  FROM base)"""


def typed(portal: Portal) -> DataFrame:
    return convert(raw_cells(portal).select(*NAMES, F.lit("events").alias(FILE), F.col(ROW_KEY).alias(ROW_NO)), COLUMNS)


def _comparable(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        key, "flag", "count", "total", F.round(F.col("price").cast("double"), 2).alias("price"),
        F.round("ratio", 3).alias("ratio"), "seen", "note")


_COMPARED = """"count", flag, total, round(CAST(price AS DOUBLE), 2) AS price,
  round(CAST(ratio AS DOUBLE), 3) AS ratio, seen, note"""


@query("convert_cells", f"WITH {EXPECTED_SQL} SELECT k AS {ROW_NO}, {_COMPARED} FROM expected")
def convert_cells(portal: Portal) -> DataFrame:
    return _comparable(typed(portal), ROW_NO)


@query("convert_drop_empty_rows", f"""WITH {EXPECTED_SQL} SELECT k AS {ROW_NO}, {_COMPARED} FROM expected
WHERE NOT (flag IS NULL AND "count" IS NULL AND total IS NULL AND price IS NULL AND ratio IS NULL
           AND seen IS NULL AND note IS NULL)""")
def convert_drop_empty_rows(portal: Portal) -> DataFrame:
    return _comparable(drop_empty_rows(typed(portal), NAMES), ROW_NO)


_REJECT_COUNTS = f"""WITH {EXPECTED_SQL}, cells AS (
  SELECT k, 'flag' AS column_name, 'bit' AS t, flag IS NULL AND NOT (k % 5 = 3 AND k % 11 <> 0 AND NOT bad) AS failed, 'maybe' AS raw FROM expected
  UNION ALL SELECT e.k, 'count', 'int', "count" IS NULL AND (e.bad OR e.k % 13 <> 2),
    CASE e.k % 13 WHEN 0 THEN 'x1' WHEN 1 THEN (cents // 100) || '.0' ELSE '3000000000' END FROM expected e JOIN base USING (k)
  UNION ALL SELECT k, 'total', 'bigint', total IS NULL, '1e3' FROM expected
  UNION ALL SELECT k, 'price', 'decimal', price IS NULL, '--5' FROM expected
  UNION ALL SELECT k, 'ratio', 'float', ratio IS NULL, '1d' FROM expected
  UNION ALL SELECT k, 'seen', 'datetime2', seen IS NULL, CASE k % 6 WHEN 4 THEN '2024' ELSE '2024-02-30' END FROM expected)
"""


@query("convert_rejects", _REJECT_COUNTS + """
SELECT 'events' AS file_name, k AS row_number, column_name, CASE WHEN k % 23 = 1 THEN '?' ELSE raw END AS raw_value,
       'Cannot convert value to ' || t || '; stored as NULL.' AS message
FROM cells WHERE failed AND k % 23 <> 0""")
def convert_rejects(portal: Portal) -> DataFrame:
    return import_errors(typed(portal))


@query("convert_result", _REJECT_COUNTS + """
SELECT (SELECT count(*) FROM expected) AS rows_read,
       (SELECT count(*) FROM expected WHERE NOT bad) AS rows_copied,
       (SELECT count(*) FROM expected WHERE bad) AS empty_rows,
       (SELECT count(*) FROM cells WHERE failed AND k % 23 <> 0) AS errors""")
def convert_result(portal: Portal) -> DataFrame:
    return import_result(typed(portal), NAMES)


@query("infer_column_types", """
SELECT ordinal, column_name, logical_type, CAST(observed_length AS INTEGER) AS observed_length,
       CAST(max_length AS INTEGER) AS max_length FROM (
WITH cells AS (
  SELECT CAST(event_id % 2 AS VARCHAR) AS switch, CAST(event_id AS VARCHAR) AS number,
         CAST(event_id + 3000000000 AS VARCHAR) AS big,
         CAST(event_id AS VARCHAR) || '.25' AS exact, CAST(event_id % 9 AS VARCHAR) || 'e30' AS wide,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen, CASE WHEN event_id < 0 THEN 'x' ELSE ' ' END AS nothing,
         event_type || ' ' || props AS words FROM events)
SELECT 0 AS ordinal, 'switch' AS column_name, 'Bit' AS logical_type, max(length(switch)) AS observed_length, NULL::INTEGER AS max_length FROM cells
UNION ALL SELECT 1, 'number', 'Int', max(length(number)), NULL FROM cells
UNION ALL SELECT 2, 'big', 'BigInt', max(length(big)), NULL FROM cells
UNION ALL SELECT 3, 'exact', 'Decimal', max(length(exact)), NULL FROM cells
UNION ALL SELECT 4, 'wide', 'Float', max(length(wide)), NULL FROM cells
UNION ALL SELECT 5, 'seen', 'DateTime2', max(length(seen)), NULL FROM cells
UNION ALL SELECT 6, 'nothing', 'NVarChar', CAST(0 * count(*) AS INTEGER), 255 FROM cells
UNION ALL SELECT 7, 'words', 'NVarChar', max(length(words)), greatest(max(length(words)), 255) FROM cells)""")
def infer_column_types(portal: Portal) -> DataFrame:
    key = F.col(ROW_KEY)
    cells = portal.raw("events").select(
        (key % 2).cast("string").alias("switch"), key.cast("string").alias("number"),
        (key + 3000000000).cast("string").alias("big"), F.concat(key, F.lit(".25")).alias("exact"),
        F.concat(key % 9, F.lit("e30")).alias("wide"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"),
        F.when(key < 0, F.lit("x")).otherwise(F.lit(" ")).alias("nothing"),
        F.concat_ws(" ", "event_type", "props").alias("words"))
    return inference_report(cells).select("ordinal", "column_name", "logical_type", "observed_length", "max_length")


@query("infer_damaged_cells", f"""
SELECT * FROM (VALUES (0, 'flag'), (1, 'count'), (2, 'total'), (3, 'price'), (4, 'ratio'), (5, 'seen'), (6, 'note'))
  AS v(ordinal, column_name), (SELECT 'NVarChar' AS logical_type, count(*) > 0 AS has_value FROM events)""")
def infer_damaged_cells(portal: Portal) -> DataFrame:
    return inference_report(raw_cells(portal), NAMES).select("ordinal", "column_name", "logical_type", "has_value")


@query("row_index_lineitem", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS row_index,
       l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def row_index_lineitem(portal: Portal) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = portal.raw("lineitem").select(*order)
    return row_index(rows, order).select("row_index", *order[:4])


@query("surrogate_key_orders", """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS "MyPK_id", o_orderkey AS "ID", o_orderdate FROM orders""")
def surrogate_key_orders(portal: Portal) -> DataFrame:
    rows = portal.raw("orders").select(F.col("o_orderkey").alias("ID"), "o_orderdate")
    return add_surrogate_key(rows, ["o_orderdate", "ID"])


def write_csv(portal: Portal) -> str:
    path = fresh_path(portal.spark, "events-text") + ".csv"
    raw_cells(portal).write.options(
        header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("read_csv_text", f"WITH {EXPECTED_SQL} SELECT k AS {ROW_NO}, {_COMPARED} FROM expected")
def read_csv_text(portal: Portal) -> DataFrame:
    """CSV written and read back: quotes, commas and line breaks survive, and so do all values."""
    rows = read_csv(portal.spark, [write_csv(portal)])
    return _comparable(convert(rows.select(*NAMES, F.col(ROW_KEY).cast("bigint").alias(ROW_NO)), COLUMNS), ROW_NO)


@query("load_table_events", f"""WITH {EXPECTED_SQL} SELECT k AS event_id, {_COMPARED},
  row_number() OVER (ORDER BY k) AS "Id" FROM expected""")
def load_table_events(portal: Portal) -> DataFrame:
    """Whole import: CSV to a published table with a dense key, bad cells as NULL."""
    table = "quayside_loads." + fresh_path(portal.spark, "t").rsplit("/", 1)[-1].replace("-", "_")
    rows = read_tabular(portal.spark, [write_csv(portal)])
    columns = [L.ColumnDef(ROW_KEY, L.BIG_INT), *COLUMNS]
    # The parts of a written folder have no order of their own: number the rows by their key.
    placed = rows.withColumn(FILE, F.lit("events")).withColumn(FILE_SEQ, F.lit(0)).withColumn(
        ROW_NO, F.col(ROW_KEY).cast("bigint"))
    load_table(placed, columns, table, on_errors="null")
    loaded = portal.spark.table(table)
    return _comparable(loaded.select("Id", F.col(ROW_KEY), *NAMES), ROW_KEY).join(
        loaded.select(ROW_KEY, "Id"), ROW_KEY)


@query("read_parquet_rows", """
SELECT count(*) AS n, CAST(1 AS BIGINT) AS first_row, count(*) AS last_row, count(*) AS distinct_rows FROM orders""")
def read_parquet_rows(portal: Portal) -> DataFrame:
    rows = read_tabular(portal.spark, [f"{portal.folder}/orders.parquet"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(ROW_NO).alias("first_row"), F.max(ROW_NO).alias("last_row"),
                    F.count_distinct(FILE, ROW_NO).alias("distinct_rows"))


@query("union_files_orders", """
SELECT o_orderkey, s AS _file_seq, o_totalprice FROM orders, (VALUES (0), (1)) AS v(s)""")
def union_files_orders(portal: Portal) -> DataFrame:
    path = f"{portal.folder}/orders.parquet"
    return read_tabular(portal.spark, [path, path]).select("o_orderkey", FILE_SEQ, "o_totalprice")


@query("align_columns_by_name", "SELECT c_nationkey AS nation, c_custkey AS key, c_name AS name FROM customer")
def align_columns_by_name(portal: Portal) -> DataFrame:
    shuffled = portal.raw("customer").select(
        F.col("c_name").alias("NAME "), F.col("c_nationkey").alias("Nation"), F.col("c_custkey").alias("KEY"))
    return align_by_name(shuffled, ["key", "name", "nation"])


@query("duplicate_headers", """
SELECT lower(p_type) AS header, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_header_names(portal: Portal) -> DataFrame:
    return duplicate_headers(portal.raw("part"), "p_type")


@query("infer_override_convert", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS DOUBLE) AS value, CAST(NULL AS BIGINT) AS props,
  (SELECT count(*) FROM events WHERE props IS NOT NULL AND trim(props) <> '') AS rejects FROM events""")
def infer_override_convert(portal: Portal) -> DataFrame:
    """Types inferred from every row, overruled by a user, and the cells converted by them."""
    keep = [F.col(c).cast("string").alias(c) for c in ("event_id", "user_id", "value", "props")]
    texts = portal.raw("events").select(*keep)
    columns = apply_overrides(infer_columns(texts), {"user_id": "NoSuchType", "value": L.FLOAT, "props": L.BIG_INT}, {"user_id": 20})
    converted = convert(texts.select("*", F.lit("events").alias(FILE), F.col("event_id").cast("bigint").alias(ROW_NO)), columns)
    failed = import_errors(converted).agg(F.count(F.lit(1)).alias("rejects"))
    rejects = failed.head()["rejects"]
    return converted.select(F.col("event_id").cast("bigint").alias("event_id"), "user_id", "value", "props", F.lit(rejects).cast("bigint").alias("rejects"))


def _names(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("index_candidates_events", """
SELECT * FROM (SELECT 'time' AS use, 'ts' AS column_name UNION ALL SELECT 'id', 'event_id' UNION ALL SELECT 'id', 'user_id' UNION ALL SELECT 'id', 'value'
  UNION ALL SELECT 'include', 'ts' UNION ALL SELECT 'include', 'event_id' UNION ALL SELECT 'include', 'user_id' UNION ALL SELECT 'include', 'value')
WHERE (SELECT count(*) FROM events) > 0""")
def index_candidates_events(portal: Portal) -> DataFrame:
    """Index columns offered for a table, by the types its cells were inferred to have."""
    events = portal.raw("events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    offered = index_column_candidates(infer_columns(events.select(*[F.col(c).cast("string").alias(c) for c in events.columns])))
    return _names(portal.spark, [(use, name) for use, names in offered.items() for name in names], "use string, column_name string")


@query("sql_types_of_columns", """
SELECT column_name, data_type, min(CASE WHEN data_type IN ('bigint') THEN 'BigInt' WHEN data_type = 'int' THEN 'Int'
  WHEN data_type IN ('float', 'real') THEN 'Float' WHEN data_type = 'datetime2' THEN 'DateTime2' ELSE 'NVarChar' END) AS logical_type,
  count(v) AS n FROM (
  SELECT 'l_orderkey' AS column_name, 'bigint' AS data_type, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem
  UNION ALL SELECT 'l_linenumber', 'int', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'float', CAST(l_quantity AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'nvarchar', l_returnflag FROM lineitem
  UNION ALL SELECT 'l_shipdate', 'datetime2', CAST(l_shipdate AS VARCHAR) FROM lineitem) GROUP BY 1, 2""")
def sql_types_of_columns(portal: Portal) -> DataFrame:
    """The logical type behind the SQL type each column is published under, beside the cells it holds."""
    rows = portal.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    found = profile(rows).select("column_name", "data_type", F.col("non_null_count").alias("n"))
    kinds = {name: L.map_sql_type(name) for name in {L.sql_name(f.dataType) for f in rows.schema}}
    logical = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return found.select("column_name", "data_type", logical[F.col("data_type")].alias("logical_type"), "n")


@query("staged_names_of_sections", """
SELECT dataset_id, section_type, substr(repeat(replace(table_name, '.', '_'), 12), 1, 128 - length('__staging__') - 32) || '__staging__' || md5(table_name) AS staged
FROM sections""", "sections")
def staged_names_of_sections(portal: Portal) -> DataFrame:
    """Names of staging tables: long names are cut so that label and job fit."""
    base = F.repeat(F.replace("table_name", F.lit("."), F.lit("_")), F.lit(12))
    return portal.sections().select("dataset_id", "section_type", staged_name_column(base, "staging", F.md5("table_name")).alias("staged"))


@query("infer_late_bad_cell", """
SELECT 0 AS ordinal, 'number' AS column_name, CASE WHEN count(*) > 0 THEN 'NVarChar' END AS logical_type FROM orders
UNION ALL SELECT 1, 'whole', CASE WHEN count(*) > 0 THEN 'Int' END FROM orders""")
def infer_late_bad_cell(portal: Portal) -> DataFrame:
    """One cell that is no number, the last of all, makes its column text: every row is tested."""
    # Marked in the stored cells themselves: the last one by key, wherever it lies.
    orders, key = portal.raw("orders"), F.col("o_orderkey")
    last = orders.select(key).orderBy(key.desc()).limit(1).select(key.alias("last"))
    cells = orders.join(last, key == F.col("last"), "left").select(
        F.when(F.col("last").isNotNull(), F.lit("x")).otherwise(key.cast("string")).alias("number"), (key + 2).cast("string").alias("whole"))
    return inference_report(cells).select("ordinal", "column_name", "logical_type")


@query("read_csv_row_numbers", """
SELECT CAST(event_id % 2 AS INTEGER) AS _file_seq, count(*) AS n, CAST(1 AS BIGINT) AS first_row, count(*) AS places FROM events GROUP BY 1""")
def read_csv_row_numbers(portal: Portal) -> DataFrame:
    """Two folders of text files, one read: the place in the list and the row numbers of every file."""
    paths = []
    for i in (0, 1):
        path = fresh_path(portal.spark, "events-part") + ".csv"
        portal.raw("events").where(F.col("event_id") % 2 == i).select("event_id", "props").write.options(
            header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)
        paths.append(path)
    rows = read_csv(portal.spark, paths)
    return rows.groupBy(FILE_SEQ).agg(F.count(F.lit(1)).alias("n"), F.min(ROW_NO).alias("first_row"),
                                      F.count_distinct(FILE, ROW_NO).alias("places"))


@query("content_hashes_of_files", "SELECT s_suppkey, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def content_hashes_of_files(portal: Portal) -> DataFrame:
    """Hashes of file contents: one small file per supplier, written and hashed."""
    path = fresh_path(portal.spark, "supplier-files")
    # A small table is one task; a file costs milliseconds, whatever it holds, so the keys are spread over all tasks.
    tasks = int(portal.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = portal.raw("supplier").select(F.col("s_suppkey").alias("key"), "s_name").repartition(tasks, "key")
    rows.write.partitionBy("key").text(path)
    found = content_hashes(portal.spark, path)
    return found.select(F.regexp_extract("path", "/key=(\\d+)/", 1).cast("bigint").alias("s_suppkey"), "sha256")
