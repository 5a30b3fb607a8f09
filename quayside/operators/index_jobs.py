"""Runs the index jobs of the section records: pending, running, then completed or failed.

The index of a Parquet table is its layout: rows range-partitioned and sorted by (id,) time and key, with page
statistics on every column and a Bloom filter on the id column, written to a fresh folder to which the table is then pointed.

States are rows of an append-only log; the newest row of a section is its state and overlays the section record. What
can be refused by looking at the records (a missing name, time column or table) is judged for all pending sections by
one plan and recorded with one append. The others are claimed one by one: a claim is the lease of the dataset, the one that
replacing takes, so no table is laid out while it is replaced, nor by two runners. A runner that died leaves a section
``running``; once its lease ran out, the section is pending again.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.errors import QuaysideError, StateError
from quayside.functions.text import truncate
from quayside.leases import Leases, utc_now
from quayside.operators.catalog import COMPLETED, FAILED, PENDING, RUNNING
from quayside.operators.guards import pending_index_jobs
from quayside.operators.replace import KEY_PROPERTY, dataset_lease
from quayside.operators.slices import IndexColumns, clustered, default_index_name
from quayside.sources.tables import point_to, quoted, table_location, table_properties, text_literal
from quayside.storage import delete_path, fresh_path, lookup_side, names_in

INDEX_PROPERTY, OLD_PROPERTY = "quayside.index", "quayside.index.old"
# Fixed value: length of a recorded error.
ERROR_LENGTH = 1000
# A runner that is silent for so long has died.
CLAIM = dt.timedelta(hours=6)
SECTION = ("dataset_id", "section_type")
LOG_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.LongType()), T.StructField("section_type", T.StringType()),
    T.StructField("revision", T.LongType()), T.StructField("index_status", T.StringType()),
    T.StructField("index_error", T.StringType()), T.StructField("at", T.TimestampNTZType()),
    T.StructField("until", T.TimestampNTZType())])


@dataclass(frozen=True)
class IndexRunResult:
    """What became of one job: its status, and why it failed or was refused."""

    status: str
    error: str | None = None


def newest_states(log: DataFrame) -> DataFrame:
    """Newest row of every section, combined per task before the shuffle."""
    rest = [c for c in log.columns if c not in SECTION]
    return log.groupBy(*SECTION).agg(F.max_by(F.struct(*rest), "revision").alias("s")).select(*SECTION, "s.*")


def with_states(sections: DataFrame, log: DataFrame, now: dt.datetime) -> DataFrame:
    """Section records with the state, error and revision of their newest log row; a claim that ran out is pending."""
    lost = (F.col("index_status") == RUNNING) & (F.col("until") <= F.lit(now))
    states = newest_states(log).select(
        *[F.col(c).alias(f"__{c}") for c in SECTION],
        F.when(lost, F.lit(PENDING)).otherwise(F.col("index_status")).alias("__status"),
        F.col("index_error").alias("__error"), F.col("revision").alias("__revision"))
    same = (F.col("dataset_id").cast("long") == F.col("__dataset_id")) & (F.col("section_type") == F.col("__section_type"))
    known = F.col("__revision").isNotNull()
    kept = [F.when(known, F.col("__status")).otherwise(F.col("index_status")).alias(c) if c == "index_status" else F.col(f"`{c}`")
            for c in sections.columns if c not in ("index_error", "revision")]
    older = F.col("index_error") if "index_error" in sections.columns else F.lit(None).cast("string")
    return sections.join(states, same, "left").select(
        *kept, F.when(known, F.col("__error")).otherwise(older).alias("index_error"), F.coalesce("__revision", F.lit(0)).alias("revision"))


def blank(text: Column) -> Column:
    return F.coalesce(F.btrim(text), F.lit("")) == ""


def full_name(stored: Column, fallback: Column) -> Column:
    """``schema.table`` of a stored table name; one without a schema has that of its section."""
    return F.when(F.instr(stored, ".") > 0, F.btrim(stored)).otherwise(F.concat(fallback, F.lit("."), F.btrim(stored)))


def refusals(jobs: DataFrame, tables: DataFrame) -> DataFrame:
    """``jobs`` with the name of their table, and why they cannot run (null if they can). ``tables(name)`` exist."""
    named = jobs.withColumn("full_name", full_name(F.col("table_name"), F.col("section_type")))
    there = lookup_side(tables.select(F.lower("name").alias("__name"), F.lit(True).alias("__there")).distinct())
    return named.join(there, F.lower("full_name") == F.col("__name"), "left").withColumn(
        "refused", F.when(blank(F.col("table_name")), "The section has no table name.")
        .when(blank(F.col("index_time")), "The section has no time column.")
        .when(F.col("__there").isNull(), F.concat(F.lit("There is no table "), "full_name", F.lit(".")))).drop("__name", "__there")


def bloom_options(df: DataFrame, column: str | None) -> dict[str, str]:
    """Writer settings for a Bloom filter on a column, sized by an estimate of its distinct values per file."""
    if not column:
        return {}
    distinct = df.agg(F.approx_count_distinct(F.col(f"`{column}`")).alias("n")).first()["n"]
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(max(1, distinct))}


def write_layout(df: DataFrame, index: IndexColumns, path: str, row_group_bytes: int | None = None, partitions: int | None = None) -> None:
    """Rows in the order of their slices, one write. Row groups know the range of every column; those that hold none
    of a wanted id are passed over by their Bloom filter where the range cannot tell."""
    writer = clustered(df, index, partitions).write.options(**bloom_options(df, index.id))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


class IndexRunner:
    """Runs index jobs against a catalogue; ``root`` is that of the table replacer, whose leases it shares."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], dt.datetime] | None = None, row_group_bytes: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_path = f"{self.root}/_index_jobs"
        self._now = now or utc_now
        self.leases = Leases(spark, f"{self.root}/_leases", self._now)
        self.row_group_bytes = row_group_bytes

    # -- states

    def log(self) -> DataFrame:
        if not names_in(self.spark, self.log_path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)

    def states(self, sections: DataFrame) -> DataFrame:
        return with_states(sections, self.log(), self._now())

    def _append(self, rows: DataFrame) -> None:
        rows.select(*LOG_SCHEMA.names).write.mode("append").parquet(self.log_path)

    def _record(self, job, step: int, status: str, error: str | None = None) -> IndexRunResult:
        now = self._now()
        row = (job["dataset_id"], job["section_type"], job["revision"] + step, status, error, now, now + CLAIM if status == RUNNING else None)
        self._append(self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1))
        return IndexRunResult(status, error)

    def _tables(self, jobs: DataFrame) -> DataFrame:
        """Tables of the schemas that the jobs name, from the catalogue."""
        schemas = [r[0] for r in jobs.select(F.split_part(full_name(F.col("table_name"), F.col("section_type")), F.lit("."), F.lit(1)).alias("s"))
                   .where("s <> ''").distinct().collect()]
        found = [(f"{s}.{r['tableName']}",) for s in schemas if self.spark.catalog.databaseExists(s)
                 for r in self.spark.sql(f"SHOW TABLES IN {quoted(s)}").collect()]
        return self.spark.createDataFrame(found, "name string")

    # -- jobs

    def run(self, sections: DataFrame, datasets: DataFrame) -> dict[str, int]:
        """Run all pending jobs of datasets that are not locked; returns how many ended in each state.

        Jobs of locked datasets, or of datasets that another job holds, stay pending.
        """
        waiting = pending_index_jobs(self.states(sections), datasets)
        judged = refusals(waiting, self._tables(waiting))
        # The refused ones of all datasets in one append; nobody else can make them run.
        now = self._now()
        refused = judged.where("refused is not null").select(
            F.col("dataset_id").cast("long").alias("dataset_id"), "section_type", (F.col("revision") + 2).alias("revision"), F.lit(FAILED).alias("index_status"),
            truncate(F.col("refused"), ERROR_LENGTH).alias("index_error"), F.lit(now).alias("at"), F.lit(None).cast("timestamp_ntz").alias("until"))
        # The others name tables that exist: no more of them than the catalogue lists.
        jobs = judged.where("refused is null").orderBy(*SECTION).collect()
        self._append(refused)
        ended = {COMPLETED: 0, FAILED: self.log().where(F.col("at") == F.lit(now)).where(F.col("index_status") == FAILED).count(), PENDING: 0}
        for job in jobs:
            ended[self._claimed(job).status] += 1
        return ended

    def run_now(self, sections: DataFrame, datasets: DataFrame, dataset_id: int, section_type: str) -> IndexRunResult:
        """Run one job, whatever its state but running; says why if it cannot."""
        mine = (F.col("dataset_id") == dataset_id) & (F.col("section_type") == section_type)
        found = self.states(sections.where(mine))
        job = refusals(found, self._tables(found)).head()
        if job is None:
            return IndexRunResult(FAILED, "There is no such index job.")
        if not job["index_enabled"]:
            return IndexRunResult(FAILED, "The section has no index.")
        if not datasets.where((F.col("id") == dataset_id) & F.col("locked")).isEmpty():
            return IndexRunResult(FAILED, "The dataset is being replaced.")
        if job["index_status"] == RUNNING:
            return IndexRunResult(FAILED, "The index job is running already.")
        if job["refused"]:
            return self._record(job, 2, FAILED, job["refused"][:ERROR_LENGTH])
        result = self._claimed(job)
        return IndexRunResult(FAILED, "Another job holds the dataset.") if result.status == PENDING else result

    def _claimed(self, job) -> IndexRunResult:
        """Pending to running by the lease of the dataset, then the layout, then the outcome."""
        owner, lease = f"index-{uuid.uuid4().hex}", dataset_lease(job["dataset_id"])
        if not self.leases.acquire(lease, owner, CLAIM):
            return IndexRunResult(PENDING)
        try:
            self._record(job, 1, RUNNING)
            try:
                self._lay_out(job, lease, owner)
            except Exception as error:  # whatever went wrong is the state of the job
                return self._record(job, 2, FAILED, (str(error) or type(error).__name__)[:ERROR_LENGTH])
            return self._record(job, 2, COMPLETED)
        finally:
            self.leases.release(lease, owner)

    def _lay_out(self, job, lease: str, owner: str) -> None:
        name = job["full_name"]
        columns = {f.lower(): f for f in self.spark.table(quoted(name)).columns}

        def column(text: str | None) -> str | None:
            if text is None or not text.strip():
                return None
            if text.strip().lower() not in columns:
                raise QuaysideError(f"The table has no column {text.strip()}.")
            return columns[text.strip().lower()]

        properties = table_properties(self.spark, name)
        time, own, include = (column(job[f"index_{x}"]) for x in ("time", "id", "include"))
        index = IndexColumns(time=time, key=columns.get(properties.get(KEY_PROPERTY, "").lower(), time), id=own, include=include)
        stated = {"name": job["index_name"] or default_index_name(name.split(".", 1)[1], own), "time": time, "id": own, "include": include}
        before = table_location(self.spark, name)
        if json.loads(properties.get(INDEX_PROPERTY, "{}")) == {**stated, "location": before}:
            return  # the index of this name is there already
        path = fresh_path(self.spark, "index")
        write_layout(self.spark.table(quoted(name)), index, path, self.row_group_bytes)
        if not self.leases.holds(lease, owner, CLAIM):
            raise StateError("Another job has taken the dataset.")
        point_to(self.spark, name, path)
        # As the catalogue spells the folder, so that the next run knows it again. Readers of the old folder may still be
        # at work: it is named here and deleted by ``purge_old_layouts``.
        kept = json.dumps({**stated, "location": table_location(self.spark, name)})
        old = json.dumps([*json.loads(properties.get(OLD_PROPERTY, "[]")), before])
        self.spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({text_literal(INDEX_PROPERTY)} = {text_literal(kept)}, "
                       f"{text_literal(OLD_PROPERTY)} = {text_literal(old)})")

    def purge_old_layouts(self, name: str) -> int:
        """Delete the folders a table had before its index jobs, once no reader needs them; returns how many."""
        old = [x for x in json.loads(table_properties(self.spark, name).get(OLD_PROPERTY, "[]")) if x != table_location(self.spark, name)]
        for path in old:
            delete_path(self.spark, path)
        self.spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({text_literal(OLD_PROPERTY)} = '[]')")
        return len(old)
