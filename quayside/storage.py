"""Materialisation in the shared folder of the cluster.

Two operators need a fixed result that later jobs read again (the dense row index and the staged
text of an import). They write it as Parquet below the shared folder that ``spark.checkpoint.dir``
names: the lineage is cut, a lost executor costs a re-read instead of a re-computation, and the
second read is columnar and can be pruned.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.errors import QuaysideError

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary folder is used in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local"):
        key = context.applicationId
        if key not in _local_dirs:
            _local_dirs[key] = tempfile.mkdtemp(prefix="quayside-")
        return _local_dirs[key]
    raise QuaysideError("set spark.checkpoint.dir to a folder that all executors share")


class JobFolders:
    """Folders made by a job, in the order they were made, and those of them that outlive it."""

    def __init__(self) -> None:
        self.made: list[str] = []
        self.kept: set[str] = set()

    def keep(self, path: str) -> str:
        self.kept.add(path)
        return path


_job: contextvars.ContextVar[JobFolders | None] = contextvars.ContextVar("job", default=None)


@contextlib.contextmanager
def job_folders(spark: SparkSession) -> Iterator[JobFolders]:
    """Every folder from ``fresh_path`` inside the block is deleted at its end, also after a failure, but for those that are
    kept because a result reads them. Blocks may be nested; each one deletes its own."""
    job = JobFolders()
    token = _job.set(job)
    try:
        yield job
    except BaseException:
        job.kept.clear()
        raise
    finally:
        _job.reset(token)
        for path in job.made:
            if path not in job.kept:
                delete_path(spark, path)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if job := _job.get():
        job.made.append(path)
    return path


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet and return the written rows; ``keep`` lets them outlive the job around it."""
    path = fresh_path(df.sparkSession, label)
    if keep and (job := _job.get()):
        job.keep(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _owned(spark: SparkSession, path: str):
    """The Hadoop file system that owns a path, and the path in it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _owned(spark, path)
    return system.exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a data folder through the Hadoop file system that owns it."""
    system, target = _owned(spark, path)
    return system.delete(target, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Give a finished folder its place; there must be nothing yet."""
    system, target = _owned(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    if system.exists(place) or not system.rename(target, place):
        raise QuaysideError(f"{to} could not be put in its place")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    system, target = _owned(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(target)) if system.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    system, target = _owned(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there already; of several writers exactly one gets True.

    Hadoop's local file system looks before it creates, which is two steps: there the file is made under another name
    and linked, which is one. Other file systems create without overwriting as one step of their own.
    """
    system, target = _owned(spark, path)
    if system.getScheme() == "file":
        place = unquote(urlsplit(target.toUri().toString()).path)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        draft = f"{place}.{uuid.uuid4().hex}.draft"
        with open(draft, "x", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(draft, place)
            return True
        except FileExistsError:
            return False
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(draft)
    try:
        stream = system.create(target, False)
    except Exception:
        if system.exists(target):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


# Size a shuffle partition is planned for, and a ceiling for wrong estimates.
PARTITION_BYTES = 256 * 1024 * 1024
MAX_PARTITIONS = 1_000_000
_UNKNOWN_SIZE = 1 << 60


# A lookup table of unknown size is broadcast up to this many rows.
LOOKUP_ROWS = 50_000


def source_bytes(df: DataFrame) -> int | None:
    """Planned size of the sources of ``df``; None when Spark does not know one of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN_SIZE for s in sizes) else sum(sizes)


def lookup_side(df: DataFrame) -> DataFrame:
    """A lookup table for a join on few, hot keys.

    When Spark knows its size, Spark decides. A table of unknown size (rows made on the driver) would
    never be broadcast, and its few keys would gather the large side in a few tasks: it is counted,
    and broadcast only if it is small.
    """
    if source_bytes(df) is not None or df.limit(LOOKUP_ROWS + 1).count() > LOOKUP_ROWS:
        return df
    return F.broadcast(df)


def sized_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of all rows: by the size of the sources, never fewer than the
    session's own setting."""
    size = source_bytes(df) or 0
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, min(-(-size // PARTITION_BYTES), MAX_PARTITIONS))
