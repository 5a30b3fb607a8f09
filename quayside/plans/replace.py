"""Queries that take ``orders`` through the replace cycle; each one shows the content after a step."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import replace as R
from quayside.operators.catalog import servable
from quayside.operators.usage import COMMITTED
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.tables import create_external, drop_table_if_exists, quoted
from quayside.storage import fresh_path

SCHEMA = "quayside_replace"


def _published(portal: Portal) -> tuple[R.TableReplacer, str]:
    """``orders`` as a table of its own, and a replacer for it."""
    spark = portal.spark
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {SCHEMA}")
    table = "orders_" + uuid.uuid4().hex[:12]
    path = fresh_path(spark, "source")
    orders = portal.raw("orders")
    orders.write.parquet(path)
    create_external(spark, f"{SCHEMA}.{table}", path, orders.schema)
    return R.TableReplacer(spark, fresh_path(spark, "replace")), table


def newer_orders(portal: Portal) -> DataFrame:
    """The orders with half a unit added to every price."""
    return portal.raw("orders").withColumn("o_totalprice", F.col("o_totalprice") + 0.5)


def _chunks(portal: Portal) -> list[DataFrame]:
    """Two chunks with shuffled columns; together they hold every order once."""
    rows = newer_orders(portal).select(
        "o_orderdate", F.col("o_custkey").alias("O_CUSTKEY"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey")
    return [rows.filter("o_orderstatus = 'O'"), rows.filter("o_orderstatus <> 'O'")]


def _staged(portal: Portal) -> tuple[R.TableReplacer, str, str]:
    replacer, table = _published(portal)
    session = replacer.start(1, SCHEMA, table).id
    first, second = _chunks(portal)
    replacer.append_chunk(session, first, chunk=1)
    replacer.append_chunk(session, second, chunk=2)
    # The same chunk again adds nothing.
    replacer.append_chunk(session, first, chunk=1)
    return replacer, table, session


_NEW = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 0.5 AS o_totalprice, o_orderdate, o_orderpriority FROM orders"
_OLD = "SELECT * FROM orders"


@query("replace_staged_rows", _NEW)
def replace_staged_rows(portal: Portal) -> DataFrame:
    replacer, _, session = _staged(portal)
    return replacer.staged(session)


@query("replace_before_commit", _OLD)
def replace_before_commit(portal: Portal) -> DataFrame:
    _, table, _ = _staged(portal)
    return portal.spark.table(quoted(f"{SCHEMA}.{table}"))


@query("replace_committed", _NEW)
def replace_committed(portal: Portal) -> DataFrame:
    replacer, table, session = _staged(portal)
    replacer.commit(session)
    return portal.spark.table(quoted(f"{SCHEMA}.{table}"))


@query("replace_pushed", _NEW)
def replace_pushed(portal: Portal) -> DataFrame:
    replacer, table, session = _staged(portal)
    replacer.commit(session)
    replacer.push(session)
    return portal.spark.table(quoted(f"{SCHEMA}.{table}"))


@query("replace_aborted", _OLD)
def replace_aborted(portal: Portal) -> DataFrame:
    replacer, table, session = _staged(portal)
    replacer.commit(session)
    replacer.abort(session)
    return portal.spark.table(quoted(f"{SCHEMA}.{table}"))


@query("replace_audit", """
SELECT 'o_totalprice' AS column_name, count(DISTINCT o_totalprice + 0.5) - count(DISTINCT o_totalprice) AS unique_delta,
       CAST(0 AS BIGINT) AS non_null_delta, round(avg(o_totalprice + 0.5) - avg(o_totalprice), 2) AS avg_delta FROM orders
UNION ALL SELECT c, 0, 0, CASE WHEN c LIKE '%key' THEN 0.0 END
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_orderdate'), ('o_orderpriority')) AS v(c)""")
def replace_audit(portal: Portal) -> DataFrame:
    replacer, _, session = _staged(portal)
    replacer.commit(session)
    return replacer.audit(session).select(
        "column_name", "unique_delta", "non_null_delta", F.round("avg_delta", 2).alias("avg_delta"))


@query("replace_transitions", """
SELECT id, status, status IN (0, 1) AS may_commit, status = 2 AS may_push, status IN (0, 1, 2) AS may_abort
FROM replace_sessions""", "replace_sessions")
def replace_transitions(portal: Portal) -> DataFrame:
    status = F.col("status")
    return portal.replace_sessions().select(
        "id", "status", R.transition_allowed_column(status, F.lit(COMMITTED)).alias("may_commit"),
        R.transition_allowed_column(status, F.lit(R.PUSHED)).alias("may_push"),
        R.transition_allowed_column(status, F.lit(R.ABORTED)).alias("may_abort"))


@query("replace_sessions_expire", """
SELECT id, 3 AS status, 4 AS revision, TIMESTAMP '1995-06-01 12:00:00' AS completed_at FROM replace_sessions
WHERE created_at <= TIMESTAMP '1995-06-01 11:00:00' AND status NOT IN (3, 4)""", "replace_sessions")
def replace_sessions_expire(portal: Portal) -> DataFrame:
    """The closing rows of all sessions past their lifetime, by one plan."""
    sessions = portal.replace_sessions().select("*", F.lit(3).alias("revision"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return R.closing_rows(sessions, dt.datetime(1995, 6, 1, 12)).select("id", "status", "revision", "completed_at")


@query("replace_session_states", """
SELECT DISTINCT ON (dataset_id) dataset_id, status, created_at FROM (
  SELECT o_custkey AS dataset_id, CAST(o_orderkey % 5 AS INTEGER) AS status, o_orderdate AS created_at, o_orderkey FROM orders)
ORDER BY dataset_id, o_orderkey DESC""")
def replace_session_states(portal: Portal) -> DataFrame:
    """Newest row per session of an append-only state log."""
    log = portal.raw("orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"),
        (F.col("o_orderkey") % 5).cast("int").alias("status"), F.col("o_orderdate").alias("created_at"))
    return R.current_states(log).select(F.col("id").alias("dataset_id"), "status", "created_at")


@query("cleared_index_metadata", """
SELECT dataset_id, section_type, index_enabled AND upper(table_name) <> 'DONNEES.T_8' AS index_enabled,
  CASE WHEN upper(table_name) <> 'DONNEES.T_8' THEN index_status END AS index_status FROM sections""", "sections")
def cleared_index_metadata(portal: Portal) -> DataFrame:
    return R.clear_index_metadata(portal.sections(), "donnees.t_8").select(
        "dataset_id", "section_type", "index_enabled", "index_status")


@query("drop_table_if_exists", "SELECT count(*) AS rows_before, false AS there_after, false AS dropped_again FROM orders")
def drop_table(portal: Portal) -> DataFrame:
    _, table = _published(portal)
    name = f"{SCHEMA}.{table}"
    before = portal.raw("orders").agg(F.count(F.lit(1)).alias("rows_before"))
    drop_table_if_exists(portal.spark, name, purge=True)
    there = portal.spark.catalog.tableExists(name)
    return before.withColumn("there_after", F.lit(there)).withColumn(
        "dropped_again", F.lit(drop_table_if_exists(portal.spark, name)))


@query("replace_keyed_table", "SELECT count(*) AS n, count(*) AS keys, 'int' AS key_type, sum(o_totalprice + 0.5) > 0 AS priced FROM orders")
def replace_keyed_table(portal: Portal) -> DataFrame:
    """A table with an INT key, replaced by chunks that are sent again: every row has a key of its own, of that type."""
    spark = portal.spark
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {SCHEMA}")
    table, path = "keyed_" + uuid.uuid4().hex[:12], fresh_path(spark, "source")
    orders = portal.raw("orders").withColumn("Id", F.col("o_orderkey").cast("int"))
    orders.write.parquet(path)
    create_external(spark, f"{SCHEMA}.{table}", path, orders.schema, {R.KEY_PROPERTY: "Id"})
    replacer = R.TableReplacer(spark, fresh_path(spark, "replace"))
    session = replacer.start(1, SCHEMA, table).id
    first, second = _chunks(portal)
    for rows, number in ((first, 1), (second, 50_000), (first, 1)):
        replacer.append_chunk(session, rows, chunk=number)
    replacer.commit(session)
    found = spark.table(quoted(f"{SCHEMA}.{table}"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Id").alias("keys"),
                     F.lit(dict(found.dtypes)["Id"]).alias("key_type"), (F.sum("o_totalprice") > 0).alias("priced"))


@query("servable_while_replacing", """
SELECT id FROM datasets WHERE allow_api AND NOT locked AND visibility = 1
  AND id NOT IN (SELECT dataset_id FROM replace_sessions WHERE status NOT IN (3, 4) AND dataset_id IS NOT NULL)""",
       "datasets replace_sessions")
def servable_while_replacing(portal: Portal) -> DataFrame:
    """A dataset is not served while one of its replace sessions is open or under review."""
    return servable(R.with_locks(portal.datasets(), portal.replace_sessions()), "public").select("id")


@query("replace_audit_from_chunks", """
SELECT column_name, CAST(0 AS BIGINT) AS non_null_delta, round(avg_delta, 2) AS avg_delta, old_min_value, true AS distinct_near
FROM (SELECT 'o_orderkey' AS column_name, 0.0 AS avg_delta, CAST(min(o_orderkey) AS VARCHAR) AS old_min_value FROM orders
UNION ALL SELECT 'o_custkey', 0.0, CAST(min(o_custkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_totalprice', avg(o_totalprice + 0.5) - avg(o_totalprice), CAST(min(o_totalprice + 0.5) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_orderdate', NULL, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') || '.0000000' FROM orders
UNION ALL SELECT 'o_orderstatus', NULL, NULL FROM orders GROUP BY 1 UNION ALL SELECT 'o_orderpriority', NULL, NULL FROM orders GROUP BY 1)""")
def replace_audit_from_chunks(portal: Portal) -> DataFrame:
    """A second replacement reviewed from what was stored of the chunks of both: neither table is read."""
    replacer, table, session = _staged(portal)
    replacer.commit(session)
    replacer.push(session)
    again = replacer.start(1, SCHEMA, table).id
    for number, rows in enumerate(_chunks(portal), 1):
        replacer.append_chunk(again, rows.withColumn("o_totalprice", F.col("o_totalprice") + 0.5), chunk=number)
    replacer.commit(again)
    orders = portal.raw("orders")
    counts = orders.agg(*[F.count_distinct(c).alias(c) for c in orders.columns]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in orders.columns])).alias("r")).select("r.*")
    audit = replacer.audit_from_sketches(again)
    near = F.abs(F.col("new_unique_count") - F.col("n")) <= 0.05 * F.col("n")
    return audit.join(counts, "column_name").select(
        "column_name", "non_null_delta", F.round("avg_delta", 2).alias("avg_delta"), "old_min_value", near.alias("distinct_near"))


@query("replace_pushed_sections", """
SELECT dataset_id, section_type, index_enabled AND dataset_id <> 8 AS index_enabled, CASE WHEN NOT (dataset_id = 8) THEN index_time END AS index_time,
  CASE WHEN NOT (dataset_id = 8) THEN index_name END AS index_name, CASE WHEN NOT (dataset_id = 8) THEN index_status END AS index_status
FROM sections""", "sections")
def replace_pushed_sections(portal: Portal) -> DataFrame:
    """The section records after a push: the index of the pushed table is void, all others are as they were."""
    replacer, table, session = _staged(portal)
    replacer.commit(session)
    own = F.when(F.col("dataset_id") == 8, F.lit(table)).otherwise(F.col("table_name"))
    _, sections = replacer.push(session, portal.sections().withColumn("table_name", own))
    return sections.select("dataset_id", "section_type", "index_enabled", "index_time", "index_name", "index_status")
