"""Schemas of many Parquet files without a job each.

One footer per listed path is read through the Hadoop file system, many at a time, and reduced to a signature: the text of its
schema and what Spark noted about it. Spark itself is asked once per distinct signature, however many files there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Footers read at a time; they wait for the file system, not for a processor.
READERS = 32
_NOTE = "org.apache.spark.sql.parquet.row.metadata"


def many_at_once(act: Callable, items: Sequence) -> list:
    """``act`` on every item, in order, by a few threads."""
    if len(items) < 2:
        return [act(x) for x in items]
    with ThreadPoolExecutor(min(READERS, len(items))) as pool:
        return list(pool.map(act, items))


def _first_file(system, status):
    """The first data file of a file or folder (in name order), or None."""
    if not status.isDirectory():
        return status
    below = [x for x in system.listStatus(status.getPath()) if x.getPath().getName()[:1] not in "._"]
    for x in sorted(below, key=lambda x: (x.isDirectory(), x.getPath().getName())):
        found = _first_file(system, x)
        if found is not None:
            return found
    return None


def signatures(spark: SparkSession, paths: Sequence[str]) -> list[str | None]:
    """What tells the schema of each file, folder or pattern; None if it has no readable footer."""
    # Every name on the way to a class is a call of its own: they are looked up once for all paths.
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    as_path, reader_of = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.parquet.hadoop.ParquetFileReader
    file_of = jvm.org.apache.parquet.hadoop.util.HadoopInputFile

    def signature(path: str) -> str | None:
        try:
            target = as_path(path)
            system = target.getFileSystem(conf)
            matches = system.globStatus(target)
            first = _first_file(system, matches[0]) if matches else None
            if first is None:
                return None
            reader = reader_of.open(file_of.fromStatus(first, conf))
            try:
                meta = reader.getFileMetaData()
                return f"{meta.getSchema().toString()}\n{meta.getKeyValueMetaData().get(_NOTE)}"
            finally:
                reader.close()
        except Exception:  # no Parquet file: Spark says why when it is asked for the schema
            return None

    return many_at_once(signature, paths)


def parquet_schemas(spark: SparkSession, paths: Sequence[str]) -> list[T.StructType]:
    """The schema of each path, in order; paths of one schema share one object."""
    paths = list(paths)
    known: dict[str, T.StructType] = {}
    found = []
    for path, text in zip(paths, signatures(spark, paths) if len(paths) > 1 else [None]):
        if text is None:
            found.append(spark.read.parquet(path).schema)
        else:
            if text not in known:
                known[text] = spark.read.parquet(path).schema
            found.append(known[text])
    return found
