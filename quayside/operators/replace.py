"""Replace the content of a table: stage, review, then push or take back.

A published table is a catalogue entry that points to a folder. Chunks are written below a staging
folder, one sub-folder per chunk. ``commit`` repoints the entry with one ``ALTER TABLE .. SET
LOCATION``; the previous folder stays registered under its old name until ``push`` drops it or
``abort`` points back to it. No data is moved or copied by any of these steps, whatever its size, and
a reader sees either the old or the new content.

Session states are rows in an append-only table; the newest row of a session is its state. The table
has no transaction of its own: a session holds the lease of its dataset (``quayside.leases``) from its
start to its end, and every state is written under that lease. Of two starts at one instant one is
refused, and a session whose dataset was taken over after its lifetime cannot write any more.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace as changed

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside import types as L
from quayside.errors import StateError
from quayside.functions.parsing import CHUNK
from quayside.functions.text import staged_name
from quayside.leases import Leases, utc_now
from quayside.operators.convert import ImportResult, convert, drop_empty_rows, import_errors, result_aggregates
from quayside.operators.headers import align_by_name
from quayside.operators.profile import compare_profiles, side_by_side
from quayside.operators.rowindex import row_index
from quayside.operators.sketches import merged_profile, sketch, sketch_schema
from quayside.operators.usage import (
    ABORTED, COMMITTED, PUSHED, SESSION_LIFETIME_HOURS, STARTED, UPLOADING, expired_sessions, instant)
from quayside.sources.tables import (
    check_identifier, create_external, drop_table_if_exists, point_to, quoted, table_exists, table_location,
    table_properties, text_literal)
from quayside.sources.tabular import LOCATION, read_parquet
from quayside.storage import delete_path, job_folders, path_exists

KEY_PROPERTY, SKETCH_PROPERTY = "quayside.key", "quayside.sketches"


@dataclass(frozen=True)
class ReplaceSession:
    id: str
    dataset_id: int
    schema_name: str
    table_name: str
    staging_table: str
    staging_path: str
    source_path: str
    old_table: str | None
    status: int
    chunks: int
    user_id: int | None
    created_at: dt.datetime
    updated_at: dt.datetime | None = None
    committed_at: dt.datetime | None = None
    completed_at: dt.datetime | None = None
    revision: int = 0
    next_key: int = 0


SESSION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset_id", T.LongType()),
    T.StructField("schema_name", T.StringType()), T.StructField("table_name", T.StringType()),
    T.StructField("staging_table", T.StringType()), T.StructField("staging_path", T.StringType()),
    T.StructField("source_path", T.StringType()), T.StructField("old_table", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("chunks", T.IntegerType()),
    T.StructField("user_id", T.LongType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()), T.StructField("committed_at", T.TimestampNTZType()),
    T.StructField("completed_at", T.TimestampNTZType()), T.StructField("revision", T.IntegerType()),
    T.StructField("next_key", T.LongType()),
])


def allowed_transition(status: int, target: int) -> bool:
    """Started, Uploading, Committed, Pushed in this order; Aborted from every open state."""
    if target == ABORTED:
        return status in (STARTED, UPLOADING, COMMITTED)
    return (status, target) in {(STARTED, UPLOADING), (UPLOADING, UPLOADING), (STARTED, COMMITTED),
                                (UPLOADING, COMMITTED), (COMMITTED, PUSHED)}


def transition_allowed_column(status, target):
    """The same rule over columns, for reports on many sessions."""
    return (
        F.when(target == ABORTED, status.isin(STARTED, UPLOADING, COMMITTED))
        .when(target == UPLOADING, status.isin(STARTED, UPLOADING))
        .when(target == COMMITTED, status.isin(STARTED, UPLOADING))
        .when(target == PUSHED, status == COMMITTED)
        .otherwise(F.lit(False)))


def current_states(log: DataFrame) -> DataFrame:
    """Newest row of every session, by a map-side combined maximum."""
    return log.groupBy("id").agg(F.max_by(F.struct(*log.columns), F.col("revision")).alias("s")).select("s.*")


# Largest key of each integer type.
_LARGEST = {T.ByteType: 2**7 - 1, T.ShortType: 2**15 - 1, T.IntegerType: 2**31 - 1, T.LongType: 2**63 - 1}


def with_locks(datasets: DataFrame, sessions: DataFrame) -> DataFrame:
    """Dataset records whose ``locked`` also says that a replace session is open or under review.

    Serving, deleting and indexing read ``locked``: give them these records.
    """
    open_ids = sessions.filter(~F.col("status").isin(ABORTED, PUSHED)).select(
        F.col("dataset_id").alias("__open")).distinct().withColumn("__locked", F.lit(True))
    joined = datasets.join(open_ids, datasets["id"] == open_ids["__open"], "left")
    locked = F.coalesce("locked", F.lit(False)) | F.coalesce("__locked", F.lit(False))
    return joined.select(*[locked.alias(c) if c == "locked" else F.col(f"`{c}`") for c in datasets.columns])


def closing_rows(sessions: DataFrame, now: dt.datetime) -> DataFrame:
    """The next state row of every session past its lifetime: aborted at ``now``. One plan for all of them."""
    at = instant(now, sessions.schema["created_at"].dataType)
    closed = {"status": F.lit(ABORTED), "updated_at": at, "completed_at": at, "revision": F.col("revision") + 1}
    return expired_sessions(sessions, now).select(*[
        closed[f.name].cast(f.dataType).alias(f.name) if f.name in closed else F.col(f"`{f.name}`") for f in sessions.schema.fields])


def dataset_lease(dataset_id: int) -> str:
    """Name of the lease of a dataset, for everything that rewrites its tables."""
    return f"dataset-{dataset_id}"


LIFETIME = dt.timedelta(hours=SESSION_LIFETIME_HOURS)


class TableReplacer:
    """Runs replace sessions against a catalogue. ``root`` holds the session log and staging data."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], dt.datetime] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_path = f"{self.root}/_sessions"
        self._now = now or utc_now
        self.leases = Leases(spark, f"{self.root}/_leases", self._now)

    # -- session rows

    def log(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.log_path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SESSION_SCHEMA)
        return self.spark.read.schema(SESSION_SCHEMA).parquet(self.log_path)

    def sessions(self) -> DataFrame:
        return current_states(self.log())

    def load(self, session_id: str) -> ReplaceSession:
        row = current_states(self.log().filter(F.col("id") == session_id)).head()
        if row is None:
            raise StateError("there is no such replace session")
        return ReplaceSession(**row.asDict())

    def _record(self, session: ReplaceSession) -> ReplaceSession:
        if not self.leases.holds(dataset_lease(session.dataset_id), session.id, LIFETIME):
            raise StateError("another job has taken the dataset of the session")
        following = changed(session, revision=session.revision + 1)
        self.spark.createDataFrame([tuple(asdict(following).values())], SESSION_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(self.log_path)
        return following

    def locked(self, dataset_id: int) -> bool:
        """A dataset is locked while one of its sessions is open or committed."""
        return not self.sessions().filter(
            (F.col("dataset_id") == dataset_id) & ~F.col("status").isin(ABORTED, PUSHED)).isEmpty()

    @staticmethod
    def _full(session: ReplaceSession, table: str) -> str:
        return f"{session.schema_name}.{table}"

    # -- steps

    def start(self, dataset_id: int, schema: str, table: str, user_id: int | None = None) -> ReplaceSession:
        """Lock the dataset and open an empty staging table with the columns of the source."""
        job, lease = uuid.uuid4().hex, dataset_lease(dataset_id)
        if not self.leases.acquire(lease, job, LIFETIME):
            raise StateError("the dataset is being replaced already")
        try:
            # Under the lease of the dataset: what outlived its time gives way to the new session.
            self._close({dataset_id})
            if self.locked(dataset_id):
                raise StateError("the dataset is being replaced already")
            return self._open(job, dataset_id, schema, table, user_id)
        except BaseException:
            self.leases.release(lease, job)
            raise

    def _open(self, job: str, dataset_id: int, schema: str, table: str, user_id: int | None) -> ReplaceSession:
        source = f"{schema}.{table}"
        if not table_exists(self.spark, source):
            raise StateError("the source table does not exist")
        staging = check_identifier(staged_name(table, "staging", job))
        path = f"{self.root}/{schema}/{staging}"
        properties = table_properties(self.spark, source)
        kept = {KEY_PROPERTY: properties[KEY_PROPERTY]} if KEY_PROPERTY in properties else {}
        create_external(self.spark, f"{schema}.{staging}", path, self.spark.table(quoted(source)).schema, kept)
        # The empty table gets a first, empty file, so that it can be read and committed as it is.
        self.spark.createDataFrame([], self.spark.table(quoted(source)).schema).coalesce(1).write.parquet(
            f"{path}/chunk-0")
        return self._record(ReplaceSession(
            job, dataset_id, schema, table, staging, path, table_location(self.spark, source), None,
            STARTED, 0, user_id, self._now()))

    def _require(self, session: ReplaceSession, target: int) -> None:
        if not allowed_transition(session.status, target):
            raise StateError("the session is not in a state for this step")

    def append_chunk(self, session_id: str, paths: list[str] | DataFrame,
                     chunk: int | None = None) -> tuple[ImportResult, DataFrame]:
        """Align, convert and add one chunk. Sending the same chunk number again replaces it.

        Columns are matched by name in any order. Returns the counts and the rejects.
        """
        session = self.load(session_id)
        self._require(session, UPLOADING)
        if session.old_table:
            raise StateError("the session is being committed")
        staging = self._full(session, session.staging_table)
        if not table_exists(self.spark, staging):
            raise StateError("the staging table of the session is missing")
        number = chunk if chunk is not None else session.chunks + 1
        source = self.spark.table(quoted(staging))
        key = table_properties(self.spark, staging).get(KEY_PROPERTY)
        target = [f for f in source.schema.fields if f.name != key]
        rows = paths if isinstance(paths, DataFrame) else read_parquet(self.spark, paths)
        place = [c for c in LOCATION if c in rows.columns]
        data = rows.drop(*place)
        aligned = align_by_name(data, [f.name for f in target])
        if place:
            # align_by_name checks the names; the location travels along.
            by_name = {c.strip().lower(): c for c in data.columns}
            aligned = rows.select(
                *[F.col(f"`{by_name[f.name.lower()]}`").alias(f.name) for f in target], *place)
        columns = L.columns_of(T.StructType(target))
        names = [c.name for c in columns]
        converted = convert(aligned, columns, CHUNK)
        counts = Observation()
        kept = drop_empty_rows(converted.observe(counts, *result_aggregates(names)), names)
        used, place = 0, f"{session.staging_path}/chunk-{number}"
        with job_folders(self.spark):   # the numbered copy of a keyed chunk goes when the chunk is written
            used = self._write_chunk(session, kept, target, source, key, place)
        self._store_sketch(session, place, number, source.schema)
        seen = counts.get
        self._record(changed(session, status=UPLOADING, chunks=max(session.chunks, number), updated_at=self._now(),
                             next_key=session.next_key + used))
        result = ImportResult(seen["rows_read"], seen["rows_copied"], seen["empty_rows"], seen["errors"], True)
        return result, import_errors(converted)

    @staticmethod
    def _write_chunk(session: ReplaceSession, kept: DataFrame, target: list, source: DataFrame, key: str | None, place: str) -> int:
        """Write the rows of a chunk; returns how many keys they took."""
        typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target]
        used = 0
        if key:
            # Keys go on from the highest one given out so far; the numbering is a write of its own and therefore fixed.
            kept = row_index(kept, (), "__key")
            used = kept.agg(F.count(F.lit(1))).head()[0]
            kind = source.schema[key].dataType
            if session.next_key + used > _LARGEST.get(type(kind), 0):
                raise StateError("the keys of the table are used up")
            typed.insert(0, (F.col("__key") + F.lit(session.next_key)).cast(kind).alias(key))
        kept.select(*typed).write.mode("overwrite").parquet(place)
        return used

    def _sketches(self, session: ReplaceSession) -> str:
        return f"{self.root}/_sketches/{session.id}"

    def _store_sketch(self, session: ReplaceSession, place: str, number: int, schema: T.StructType) -> None:
        """One row of mergeable statistics about the chunk as it was written; sent again, it replaces its own."""
        rows = self.spark.read.schema(schema).parquet(place)
        sketch(rows).coalesce(1).write.mode("overwrite").parquet(f"{self._sketches(session)}/chunk-{number}")

    def staged(self, session_id: str) -> DataFrame:
        """Rows of all chunks so far."""
        session = self.load(session_id)
        schema = self.spark.table(quoted(self._full(session, session.staging_table))).schema
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(session.staging_path)

    def commit(self, session_id: str) -> ReplaceSession:
        """Keep the present content under the old name and point the table to the staged content.

        The intent is recorded first and every later step may be repeated: a commit that was cut off is finished by
        calling it, or ``recover``, again.
        """
        session = self.load(session_id)
        self._require(session, COMMITTED)
        if not session.old_table:
            if not table_exists(self.spark, self._full(session, session.staging_table)):
                raise StateError("the staging table of the session is missing")
            old = self._old_name(session)
            if table_exists(self.spark, self._full(session, old)):
                raise StateError("the name for the old table is taken")
            session = self._record(changed(session, old_table=old, updated_at=self._now()))
        return self._finish(session)

    @staticmethod
    def _old_name(session: ReplaceSession) -> str:
        return check_identifier(staged_name(session.table_name, "old", session.id))

    def _finish(self, session: ReplaceSession) -> ReplaceSession:
        old, source = self._full(session, session.old_table), self._full(session, session.table_name)
        if not table_exists(self.spark, old):
            properties = {k: v for k, v in table_properties(self.spark, source).items() if k in (KEY_PROPERTY, SKETCH_PROPERTY)}
            create_external(self.spark, old, session.source_path, self.spark.table(quoted(source)).schema, properties)
        point_to(self.spark, source, session.staging_path)
        drop_table_if_exists(self.spark, self._full(session, session.staging_table))
        at = self._now()
        return self._record(changed(session, status=COMMITTED, committed_at=at, updated_at=at))

    def audit(self, session_id: str) -> DataFrame:
        """Profiles of the old and the new content, per column, for the review before the push."""
        session = self.load(session_id)
        if session.status != COMMITTED:
            raise StateError("only a committed session can be reviewed")
        return compare_profiles(self.spark.table(quoted(self._full(session, session.old_table))),
                                self.spark.table(quoted(self._full(session, session.table_name))))

    def audit_from_sketches(self, session_id: str) -> DataFrame:
        """The same review from the statistics that were stored chunk by chunk.

        The new content is not read again. The old one is not either if it came by a replacement; otherwise it is
        summed up once, and that is kept with the session. Distinct counts are estimates.
        """
        session = self.load(session_id)
        if session.status != COMMITTED:
            raise StateError("only a committed session can be reviewed")
        old = self._full(session, session.old_table)
        schema = self.spark.table(quoted(old)).schema
        stored = table_properties(self.spark, old).get(SKETCH_PROPERTY)
        if not stored:
            stored = f"{self._sketches(session)}-old"
            sketch(self.spark.table(quoted(old))).coalesce(1).write.mode("overwrite").parquet(stored)
        read = lambda path: self.spark.read.schema(sketch_schema(schema)).option("recursiveFileLookup", True).parquet(path)
        if not path_exists(self.spark, self._sketches(session)):
            sketch(self.spark.table(quoted(self._full(session, session.table_name)))).coalesce(1).write.parquet(self._sketches(session))
        return side_by_side(merged_profile(read(stored), schema), merged_profile(read(self._sketches(session)), schema))

    def push(self, session_id: str, sections: DataFrame | None = None):
        """Finalise: drop the old content and unlock. The index of the section is void: given the section records,
        their new state is returned too."""
        session = self.load(session_id)
        if session.status != COMMITTED or not session.old_table:
            raise StateError("only a committed session can be pushed")
        drop_table_if_exists(self.spark, self._full(session, session.old_table))
        delete_path(self.spark, session.source_path)
        # From now on the statistics of the chunks are those of the table.
        name = quoted(self._full(session, session.table_name))
        if path_exists(self.spark, self._sketches(session)):
            self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({text_literal(SKETCH_PROPERTY)} = {text_literal(self._sketches(session))})")
        else:
            self.spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ({text_literal(SKETCH_PROPERTY)})")
        at = self._now()
        pushed = self._record(changed(session, status=PUSHED, completed_at=at, updated_at=at))
        self.leases.release(dataset_lease(session.dataset_id), session.id)
        return pushed if sections is None else (pushed, clear_index_metadata(sections, session.table_name))

    def abort(self, session_id: str) -> ReplaceSession:
        """Undo: a table that was repointed gets its old content back, staged rows are dropped."""
        session = self.load(session_id)
        if not allowed_transition(session.status, ABORTED):
            raise StateError("the session is closed already")
        self._take_back(session, lambda name: table_exists(self.spark, name))
        at = self._now()
        aborted = self._record(changed(session, status=ABORTED, completed_at=at, updated_at=at))
        self.leases.release(dataset_lease(session.dataset_id), session.id)
        return aborted

    def _take_back(self, session: ReplaceSession, exists: Callable[[str], bool]) -> None:
        """The catalogue steps of an abort; each may be repeated."""
        if session.old_table and exists(self._full(session, session.table_name)):
            point_to(self.spark, self._full(session, session.table_name), session.source_path)
        for name in (self._old_name(session), session.staging_table):
            if exists(self._full(session, name)):
                drop_table_if_exists(self.spark, self._full(session, name))
        delete_path(self.spark, session.staging_path)
        for path in (self._sketches(session), self._sketches(session) + "-old"):
            delete_path(self.spark, path)

    def abort_expired(self) -> int:
        """Abort all sessions past their lifetime; returns how many.

        Each is taken over by its dataset's lease first. Their catalogue steps come from one list, and their closing
        rows are one append.
        """
        closer, taken = f"expiry-{uuid.uuid4().hex}", set()
        due = expired_sessions(self.sessions(), self._now()).select("dataset_id").distinct().orderBy("dataset_id").collect()
        for dataset_id, in due:
            if self.leases.acquire(dataset_lease(dataset_id), closer, LIFETIME):
                taken.add(dataset_id)
        try:
            return self._close(taken)
        finally:
            for dataset_id in taken:
                self.leases.release(dataset_lease(dataset_id), closer)

    def _close(self, datasets: set[int]) -> int:
        """Close the sessions of these datasets, whose leases the caller has, that outlived their time."""
        if not datasets:
            return 0
        of = self.spark.createDataFrame([(x,) for x in sorted(datasets)], "dataset_id long")
        now = self._now()
        # States are read under the leases: a session that ended meanwhile is not due any more.
        due = [ReplaceSession(**r.asDict()) for r in expired_sessions(self.sessions(), now).join(of, "dataset_id", "left_semi").collect()]
        if not due:
            return 0
        tables = {}
        for schema in {s.schema_name for s in due}:
            found = self.spark.sql(f"SHOW TABLES IN {quoted(schema)}").collect() if self.spark.catalog.databaseExists(schema) else []
            tables[schema] = {f"{schema}.{r['tableName']}".lower() for r in found}
        for session in due:
            self._take_back(session, lambda name: name.lower() in tables[name.split(".", 1)[0]])
        closing = closing_rows(self.sessions().join(of, "dataset_id", "left_semi"), now)
        closing.select(*SESSION_SCHEMA.names).coalesce(1).write.mode("append").parquet(self.log_path)
        return len(due)

    def recover(self, session_id: str) -> ReplaceSession:
        """Finish a commit that stopped between its steps; other sessions are left as they are."""
        session = self.load(session_id)
        if session.status not in (STARTED, UPLOADING) or not session.old_table:
            return session
        return self._finish(session)


def clear_index_metadata(sections: DataFrame, table_name: str) -> DataFrame:
    """Section records after a push: the index of the replaced table is void."""
    hit = F.upper("table_name") == table_name.upper()
    cleared = {"index_enabled": F.lit(False)}
    cleared.update({c: F.lit(None) for c in ("index_time", "index_id", "index_include", "index_type", "index_name", "index_status", "index_error")
                    if c in sections.columns})
    return sections.select(*[
        F.when(hit, cleared[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in cleared else F.col(f.name) for f in sections.schema.fields])
