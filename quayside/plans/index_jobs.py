"""Queries that run the index jobs of the section records."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.index_jobs import CLAIM, LOG_SCHEMA, IndexRunner, with_states
from quayside.operators.replace import dataset_lease
from quayside.operators.slices import IndexColumns, slice_rows
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.tables import create_external, drop_table_if_exists, quoted
from quayside.storage import fresh_path

SCHEMA = "quayside_index"
# Datasets whose main section has a table: one that fits its index, one without the id column, one that another job holds.
FITTING, UNFIT, HELD = 60, 120, 240
_SECTIONS = f"""stated AS (SELECT dataset_id, section_type, index_enabled, index_status, index_id, index_include,
  CASE WHEN dataset_id % 50 <> 0 THEN index_time END AS index_time,
  CASE WHEN dataset_id % 70 <> 0 THEN replace(table_name, 'donnees.', '{SCHEMA}.') END AS table_name FROM sections)"""


def _sections(portal: Portal) -> DataFrame:
    """The section records; some lack their time column or table name, main sections live in a schema of their own."""
    key = F.col("dataset_id")
    return portal.sections().withColumn("index_time", F.when(key % 50 != 0, F.col("index_time"))).withColumn(
        "table_name", F.when(key % 70 != 0, F.replace("table_name", F.lit("donnees."), F.lit(f"{SCHEMA}."))))


def _run(portal: Portal) -> tuple[IndexRunner, DataFrame]:
    """All pending jobs run against three tables made of the events."""
    spark = portal.spark
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {SCHEMA}")
    events = portal.raw("events").select("event_id", "ts", F.col("user_id").alias("sensor"), "value")
    for key in (FITTING, UNFIT, HELD):
        name, path = f"{SCHEMA}.T_{key}", fresh_path(spark, "index-source")
        rows = events.drop("sensor") if key == UNFIT else events
        rows.write.parquet(path)
        drop_table_if_exists(spark, name)
        create_external(spark, name, path, rows.schema)
    runner = IndexRunner(spark, fresh_path(spark, "index-jobs"))
    runner.leases.acquire(dataset_lease(HELD), f"replacing-{uuid.uuid4().hex}", CLAIM)
    sections = _sections(portal)
    runner.run(sections, portal.datasets())
    return runner, sections


@query("index_run_states", f""", {_SECTIONS},
judged AS (
  SELECT s.*, coalesce(index_enabled AND index_status = 'pending', false) AND s.dataset_id NOT IN (SELECT id FROM datasets WHERE locked) AS runs,
    coalesce(table_name IN ('{SCHEMA}.T_{FITTING}', '{SCHEMA}.T_{UNFIT}', '{SCHEMA}.T_{HELD}'), false) AS there FROM stated s)
SELECT dataset_id, section_type,
  CASE WHEN NOT runs OR (there AND dataset_id = {HELD}) THEN index_status
       WHEN there AND dataset_id = {FITTING} THEN 'completed' WHEN runs THEN 'failed' ELSE index_status END AS index_status,
  CASE WHEN NOT runs THEN NULL WHEN table_name IS NULL THEN 'The section has no table name.'
       WHEN index_time IS NULL THEN 'The section has no time column.'
       WHEN NOT there THEN 'There is no table ' || table_name || '.'
       WHEN dataset_id = {UNFIT} THEN 'The table has no column sensor.' END AS index_error
FROM judged""", "sections datasets")
def index_run_states(portal: Portal) -> DataFrame:
    """States of all sections after a run: completed, failed, and still pending where the dataset is locked or held."""
    runner, sections = _run(portal)
    return runner.states(sections).select("dataset_id", "section_type", "index_status", "index_error")


@query("index_run_slice", "SELECT event_id, ts, user_id AS sensor, value FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05 00:00:00'")
def index_run_slice(portal: Portal) -> DataFrame:
    """A slice of the table after its index job: the rows are those from before, in another layout."""
    _run(portal)
    index = IndexColumns(time="ts", key="event_id", id="sensor", include="value")
    return slice_rows(portal.spark.table(quoted(f"{SCHEMA}.T_{FITTING}")), index, "2024-01-05", None, "7")


@query("index_claims_run_out", """
SELECT dataset_id, section_type, CASE WHEN dataset_id % 2 = 0 AND dataset_id % 3 = 0 THEN 'pending'
  WHEN dataset_id % 2 = 0 THEN 'running' ELSE index_status END AS index_status,
  CAST(CASE WHEN dataset_id % 2 = 0 THEN 7 ELSE 0 END AS BIGINT) AS revision FROM sections""", "sections")
def index_claims_run_out(portal: Portal) -> DataFrame:
    """Sections under the newest rows of a log: a claim that ran out makes its section pending again."""
    now = dt.datetime(2024, 6, 1)
    sections = portal.sections()
    even = sections.where("dataset_id % 2 = 0")
    until = F.when(F.col("dataset_id") % 3 == 0, F.lit(now)).otherwise(F.lit(now + CLAIM))
    kinds = {"index_status": F.lit("running"), "revision": F.lit(7).cast("long"), "index_error": F.lit(None).cast("string"),
             "at": F.lit(now - CLAIM), "until": until}
    newest = even.select(*[kinds.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])
    older = newest.withColumn("revision", F.lit(3).cast("long")).withColumn("index_status", F.lit("failed"))
    return with_states(sections, newest.unionByName(older), now).select("dataset_id", "section_type", "index_status", "revision")
