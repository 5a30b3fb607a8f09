"""A sink for running aggregates whose folder does not grow with the number of batches.

A stream in output mode ``update`` sends the new value of every key that changed. Each batch is merged with the open
state before it into a new generation, a folder of its own; what can never change again leaves the state for an archive
of finished rows. Readers take the newest complete generation. The one before stays for those who are just reading it;
older ones are deleted. A batch that is sent again reads the same generation as the first time and writes the same
folders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quayside.storage import delete_path, names_in, path_exists

NOTHING_SEEN = -(1 << 62)
# The state, and the instant (in microseconds) before which nothing can change any more: what stays open, and what is finished.
Settle = Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Generation:
    """State after a batch; ``newest`` is the latest event time seen so far, in microseconds."""

    batch: int
    newest: int
    path: str


def generations(spark: SparkSession, path: str) -> list[Generation]:
    """Complete generations, oldest first."""
    found = []
    for name in names_in(spark, f"{path}/open"):
        _, batch, newest = name.split("_")
        folder = f"{path}/open/{name}"
        if path_exists(spark, f"{folder}/_SUCCESS"):
            found.append(Generation(int(batch), int(newest), folder))
    return sorted(found, key=lambda g: g.batch)


def open_state(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the newest generation: all that may still change."""
    found = generations(spark, path)
    return spark.read.schema(schema).parquet(found[-1].path) if found else spark.createDataFrame([], schema)


def finished(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows that can change no more, from all batches."""
    folders = [f"{path}/finished/{name}" for name in names_in(spark, f"{path}/finished")]
    folders = [x for x in folders if path_exists(spark, f"{x}/_SUCCESS")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], time: str, delay: dt.timedelta, settle: Settle) -> None:
    """One batch of updates into the next generation. ``time`` is the latest event time of a row, ``delay`` that of the watermark."""
    spark = batch.sparkSession
    before = [g for g in generations(spark, path) if g.batch < batch_id]
    last = before[-1] if before else None
    state = batch
    newest = last.newest if last else NOTHING_SEEN
    seen = batch.agg(F.max(F.unix_micros(time)).alias("m")).head()["m"]
    if last:
        # An update replaces the row of its key; the batch itself has each key once.
        kept = spark.read.schema(batch.schema).parquet(last.path).join(batch.select(*keys), list(keys), "left_anti")
        state = kept.select(*batch.columns).unionByName(batch)
    # The stream still takes rows that are later than the watermark of the batch before: what it had seen by then counts.
    horizon = newest - int(delay.total_seconds() * 1e6) if newest != NOTHING_SEEN else NOTHING_SEEN
    staying, done = settle(state, horizon)
    if horizon != NOTHING_SEEN and not done.isEmpty():
        done.write.mode("overwrite").parquet(f"{path}/finished/batch_{batch_id:012d}")
    after = max(newest, seen) if seen is not None else newest
    staying.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/open/gen_{batch_id:012d}_{after}")
    for old in before[:-1]:
        delete_path(spark, old.path)


def into_generations(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time: str, delay: dt.timedelta,
                     settle: Settle) -> StreamingQuery:
    """Run what is available now of an updating stream into generations below ``path``."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read by several jobs; a lost part is made again from the stream's state
        try:
            merge_batch(held, batch_id, path, keys, time, delay, settle)
        finally:
            held.unpersist()

    return (stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def at_micros(micros: int):
    """The instant as a column."""
    return F.timestamp_micros(F.lit(micros))
