"""Streaming queries: the event table is replayed by a file source until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.times import utc_zoneless
from quayside.plans import replace as P
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.plans.usage import _ATTEMPTS, _TOKENS
from quayside.storage import fresh_path
from quayside.streaming import quotas as Q
from quayside.streaming.ingest import stream_chunks

# A window is emitted once the watermark, ten minutes behind the newest keyed event, has passed its end.
_CLOSED = "window_end <= (SELECT max({0}) FROM {1} WHERE {2} IS NOT NULL) - INTERVAL 10 MINUTE"


def event_stream(portal: Portal) -> DataFrame:
    schema = portal.raw("events").schema
    return Q.log_stream(portal.spark, portal.folder, schema, "ts", "events.parquet")


def log_stream(portal: Portal) -> DataFrame:
    return event_stream(portal).select(
        F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 20).alias("token_id"),
        F.col("ts").alias("accessed_at"), F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"))


def _zoneless(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, utc_zoneless(F.col(name)))
    return df


@query("stream_daily_quota", """
SELECT date_trunc('day', accessed_at) AS day, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes,
       sum(bytes) >= 16000000 AS exceeded FROM access_log GROUP BY 1""", "access_log")
def stream_daily_quota(portal: Portal) -> DataFrame:
    path = fresh_path(portal.spark, "daily")
    Q.run_daily_quota(log_stream(portal), path, path + "-checkpoint", limit=16_000_000).awaitTermination()
    return _zoneless(Q.daily_state(portal.spark, path), "day")


@query("stream_token_quota", _TOKENS + f"SELECT *, bytes >= 500000 AS exceeded FROM islands WHERE {_CLOSED.format('accessed_at', 'access_log', 'token_id')}", "access_log")
def stream_token_quota(portal: Portal) -> DataFrame:
    path = fresh_path(portal.spark, "tokens")
    Q.append_to(Q.token_quota_stream(log_stream(portal), limit=500_000), path, path + "-checkpoint").awaitTermination()
    return _zoneless(portal.spark.read.parquet(path), "window_start", "window_end")


@query("stream_token_live", _TOKENS + "SELECT *, bytes >= 500000 AS exceeded FROM islands", "access_log")
def stream_token_live(portal: Portal) -> DataFrame:
    """All windows, open ones included, from the running slots of the stream."""
    path = fresh_path(portal.spark, "slots")
    Q.run_token_slots(log_stream(portal), path, path + "-checkpoint").awaitTermination()
    return _zoneless(Q.live_token_windows(portal.spark, path, limit=500_000), "window_start", "window_end")


@query("stream_attempt_limit", _ATTEMPTS + f"SELECT *, events > 5 AS limited FROM islands WHERE {_CLOSED.format('ts', 'attempts', 'who')}")
def stream_attempt_limit(portal: Portal) -> DataFrame:
    attempts = event_stream(portal).select(
        F.upper(F.concat_ws("-", "event_type", F.col("user_id") % 40)).alias("who"), "ts")
    path = fresh_path(portal.spark, "attempts")
    Q.append_to(Q.attempt_limit_stream(attempts, "who", "ts", 5, 120), path, path + "-checkpoint").awaitTermination()
    return _zoneless(portal.spark.read.parquet(path), "window_start", "window_end")


@query("stream_chunked_append", P._NEW)
def stream_chunked_append(portal: Portal) -> DataFrame:
    """Chunk files that arrive in a folder are staged by a stream and committed."""
    replacer, table = P._published(portal)
    session = replacer.start(1, P.SCHEMA, table).id
    folder = fresh_path(portal.spark, "incoming-" + uuid.uuid4().hex[:6])
    rows = P.newer_orders(portal)
    rows.repartition(3, "o_orderkey").write.parquet(folder)
    stream_chunks(replacer, session, folder, rows.schema, folder + "-checkpoint", files_per_batch=1).awaitTermination()
    replacer.commit(session)
    return portal.spark.table(f"{P.SCHEMA}.{table}")
