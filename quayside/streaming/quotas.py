"""Quotas and attempt limits over a stream of log rows.

Event time must be TIMESTAMP: ``log_stream`` turns a zoneless column into UTC instants. State lives in Spark's own
windowed aggregations and is bounded by the watermark. Daily sums, slots and sessions are combined per task before the
shuffle, so a hot token costs one row per task and session. Running values go to generations (``streaming.generations``),
which hold what is still open.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quayside.functions.times import utc_instant
from quayside.operators.usage import (
    PUBLIC_DAILY_BYTES, TOKEN_BYTES, TOKEN_WINDOW_MINUTES, activity_slots, chain_slots, numbered_runs, used_up)
from quayside.streaming.generations import NOTHING_SEEN, Settle, at_micros, finished, into_generations, open_state

# Merge the sessions of a task before the shuffle instead of sending every event to the task of its key.
_MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def log_stream(spark: SparkSession, folder: str, schema: T.StructType, time: str, pattern: str = "*",
               files_per_batch: int = 1000) -> DataFrame:
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    zoneless = isinstance(schema[time].dataType, T.TimestampNTZType)
    return stream.withColumn(time, utc_instant(F.col(time))) if zoneless else stream


def daily_quota_stream(log: DataFrame, limit: int = PUBLIC_DAILY_BYTES, delay: str = "1 hour",
                       time: str = "accessed_at") -> DataFrame:
    """Running bytes per UTC day; use output mode ``update``."""
    return (
        log.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests"), F.max(time).alias("last_at"))
        .select(F.col("w.start").alias("day"), "requests", "bytes", used_up(limit).alias("exceeded"), "last_at")
    )


DAYS = "day timestamp, requests long, bytes long, exceeded boolean, last_at timestamp"


def settled_days(state: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Days that may still grow, and those that are over for good."""
    over = F.col("day") + F.expr("INTERVAL 1 DAY") <= at_micros(max(horizon, 0))
    return state.where(~over), state.where(over)


def run_daily_quota(log: DataFrame, path: str, checkpoint: str, limit: int = PUBLIC_DAILY_BYTES, delay_minutes: int = 60,
                    time: str = "accessed_at") -> StreamingQuery:
    """Keep the bytes per UTC day below ``path``; ``daily_state`` reads them."""
    stream = daily_quota_stream(log, limit, f"{delay_minutes} minutes", time)
    return into_generations(stream, path, checkpoint, ["day"], "last_at", dt.timedelta(minutes=delay_minutes), settled_days)


def daily_state(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of every day so far."""
    return finished(spark, path, DAYS).unionByName(open_state(spark, path, DAYS)).drop("last_at")


def _session_stream(log: DataFrame, key: str, time: str, minutes: int, delay: str,
                    sums: Sequence[str]) -> DataFrame:
    return (
        log.filter(F.col(key).isNotNull()).withWatermark(time, delay)
        .groupBy(F.col(key), F.session_window(time, f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(c) for c in sums])
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", *sums)
    )


def token_quota_stream(log: DataFrame, limit: int = TOKEN_BYTES, minutes: int = TOKEN_WINDOW_MINUTES,
                       delay: str = "10 minutes", time: str = "accessed_at") -> DataFrame:
    """Quota windows per token, each one emitted when it is closed (output mode ``append``)."""
    return _session_stream(log, "token_id", time, minutes, delay, ["bytes"]).withColumn(
        "exceeded", used_up(limit))


def attempt_limit_stream(attempts: DataFrame, key: str, time: str, limit: int, minutes: int,
                         delay: str = "10 minutes") -> DataFrame:
    """Attempt windows per key (any case), each one emitted when it is closed."""
    keyed = attempts.withColumn(key, F.lower(F.col(key).cast("string")))
    return _session_stream(keyed, key, time, minutes, delay, []).withColumn("limited", F.col("events") > limit)


def token_slots_stream(log: DataFrame, minutes: int = TOKEN_WINDOW_MINUTES, delay: str = "10 minutes",
                       time: str = "accessed_at") -> DataFrame:
    """Running slots per token, for windows that are still open (output mode ``update``).

    Session windows have no update mode. The slots do, and ``open_token_windows`` chains the newest
    state of all slots into the windows a quota check needs.
    """
    slots = activity_slots(log.withWatermark(time, delay), "token_id", time, minutes, ["bytes"])
    return slots.select("token_id", F.col("slot.start").alias("slot"), "events", "first_at", "last_at", "bytes")


SLOTS = "token_id {kind}, slot timestamp, events long, first_at timestamp, last_at timestamp, bytes long"
RUNS = "token_id {kind}, window_start timestamp, window_end timestamp, events long, bytes long"


def settled_slots(minutes: int = TOKEN_WINDOW_MINUTES) -> Settle:
    """How slots of tokens leave the state.

    A slot that ends by the horizon is final. A run is over if no slot that may still come or grow (it ends after the horizon, so
    it starts at most ``minutes`` before it) can touch it: it becomes one finished window. The final slots of a run
    that is still open become one row, so an endless run of activity takes a few rows.
    """
    gap = F.make_dt_interval(mins=F.lit(minutes))

    def settle(state: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
        if horizon == NOTHING_SEEN:
            return state, state.limit(0)
        edge = at_micros(horizon)
        runs = numbered_runs(state, "token_id", minutes)
        ends = runs.withColumn("_last", F.max("last_at").over(Window.partitionBy("token_id", "_run")))
        over = F.col("_last") + gap + gap <= edge
        first = F.min("slot").over(Window.partitionBy("token_id", "_run"))
        final = F.col("slot") + gap <= edge
        staying = ends.where(~over).withColumn("slot", F.when(final, first).otherwise(F.col("slot"))).groupBy("token_id", "_run", "slot").agg(
            F.sum("events").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("bytes").alias("bytes"))
        return staying.drop("_run"), chain_slots(ends.where(over).drop("_run", "_last"), "token_id", minutes, ["bytes"])

    return settle


def run_token_slots(log: DataFrame, path: str, checkpoint: str, minutes: int = TOKEN_WINDOW_MINUTES, delay_minutes: int = 10,
                    time: str = "accessed_at") -> StreamingQuery:
    """Keep the open slots of all tokens below ``path``, and the windows that are over."""
    stream = token_slots_stream(log, minutes, f"{delay_minutes} minutes", time)
    return into_generations(stream, path, checkpoint, ["token_id", "slot"], "last_at", dt.timedelta(minutes=delay_minutes), settled_slots(minutes))


def open_token_windows(spark: SparkSession, path: str, kind: str = "long", limit: int = TOKEN_BYTES,
                       minutes: int = TOKEN_WINDOW_MINUTES) -> DataFrame:
    """What a quota check reads: the windows that may still grow, from one generation."""
    slots = open_state(spark, path, SLOTS.format(kind=kind))
    return chain_slots(slots, "token_id", minutes, ["bytes"]).withColumn("exceeded", used_up(limit))


def live_token_windows(spark: SparkSession, path: str, kind: str = "long", limit: int = TOKEN_BYTES,
                       minutes: int = TOKEN_WINDOW_MINUTES) -> DataFrame:
    """All quota windows per token so far, open ones included."""
    over = finished(spark, path, RUNS.format(kind=kind)).withColumn("exceeded", used_up(limit))
    return over.unionByName(open_token_windows(spark, path, kind, limit, minutes))


@contextmanager
def merged_sessions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside merge the sessions of a task before they are shuffled."""
    before = spark.conf.get(_MERGE_SESSIONS)
    spark.conf.set(_MERGE_SESSIONS, "true")
    try:
        yield
    finally:
        spark.conf.set(_MERGE_SESSIONS, before)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is available now into a Parquet folder; exactly once per row."""
    with merged_sessions(stream.sparkSession):  # a query keeps the settings it was started with
        return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
