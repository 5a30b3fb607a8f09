"""Access-log reports, byte quotas, tokens and download counters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import display_name
from quayside.functions.times import utc_instant, utc_zoneless
from quayside.operators.catalog import filter_optional

# Quotas, windows and lifetimes.
PUBLIC_DAILY_BYTES = 10 * 1024 ** 3
TOKEN_BYTES = 1024 ** 3
TOKEN_WINDOW_MINUTES = 60
TOKEN_LIFETIME_HOURS = 12
SESSION_LIFETIME_HOURS = 1
LOG_ROWS = 500
# Start of the key of a daily quota.
PUBLIC_QUOTA_KEY = "notebook-public:"
# Replace session states.
STARTED, UPLOADING, COMMITTED, ABORTED, PUSHED = 0, 1, 2, 3, 4


def instant(value: dt.datetime | str, like: T.DataType) -> Column:
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value
    return F.lit(text).cast(like)


def _name_of(df: DataFrame, key: str, **names: Column) -> DataFrame:
    return df.select(F.col("id").alias(key), *[c.alias(n) for n, c in names.items()])


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive bounds on a time column."""
    kind = df.schema[column].dataType
    if start is not None:
        df = df.filter(F.col(column) >= instant(start, kind))
    if end is not None:
        df = df.filter(F.col(column) <= instant(end, kind))
    return df


def _label(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Left join on a key that may be NULL in many rows: those find nothing, and a salt spreads them over the tasks."""
    salt = F.when(F.col(key).isNull(), F.xxhash64("id"))
    salted = names.withColumn("__salt", F.lit(None).cast("bigint")).withColumnRenamed(key, "__key")
    joined = rows.withColumn("__spread", salt).join(
        salted, (F.col(key) == F.col("__key")) & F.col("__spread").eqNullSafe(F.col("__salt")), "left")
    return joined.drop("__spread", "__salt", "__key")


def access_log(log: DataFrame, datasets: DataFrame, users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Log rows with dataset, user and token labels. The log is the large side of every join."""
    people = _name_of(users, "user_id", user_name=display_name(F.col("first_name"), F.col("last_name")))
    return (
        log.join(_name_of(datasets, "dataset_id", dataset_name=F.col("name")), "dataset_id", "left")
        .transform(_label, people, "user_id").transform(_label, _name_of(tokens, "token_id", token_label=F.col("label")), "token_id")
        .select("id", "dataset_id", F.coalesce("dataset_name", F.lit("")).alias("dataset_name"),
                "user_id", "user_name", "token_id", "token_label", "accessed_at", "bytes")
    )


def latest(df: DataFrame, time: str, key: str, n: int = LOG_ROWS) -> DataFrame:
    """Newest rows first; the key breaks ties."""
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)


def access_log_report(log: DataFrame, datasets: DataFrame, users: DataFrame, tokens: DataFrame,
                      start=None, end=None, n: int = LOG_ROWS, **wanted) -> DataFrame:
    """Filtered log, newest ``n`` rows, labelled. The limit comes before the joins: only the rows
    that are shown are joined."""
    rows = latest(date_range(filter_optional(log, **wanted), "accessed_at", start, end), "accessed_at", "id", n)
    return access_log(rows, datasets, users, tokens).orderBy(F.col("accessed_at").desc(), F.col("id").desc())


def replace_sessions(sessions: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with dataset and user labels."""
    people = _name_of(users, "user_id", user_name=display_name(F.col("first_name"), F.col("last_name")))
    named = _name_of(datasets, "dataset_id", dataset_name=F.col("name"), dataset_owner_id=F.col("owner_id"))
    return sessions.join(named, "dataset_id", "left").join(people, "user_id", "left").withColumn(
        "dataset_name", F.coalesce("dataset_name", F.lit("")))


def replace_session_report(sessions: DataFrame, datasets: DataFrame, users: DataFrame,
                           owner_id: int | None = None, start=None, end=None, n: int = LOG_ROWS,
                           **wanted) -> DataFrame:
    """Filtered sessions, newest first; an editor sees only those of own datasets."""
    rows = date_range(filter_optional(sessions, **wanted), "created_at", start, end)
    if owner_id is not None:
        own = datasets.filter(F.col("owner_id") == owner_id).select(F.col("id").alias("dataset_id"))
        rows = rows.join(own, "dataset_id", "left_semi")
    # Only the rows that are shown are joined with their labels.
    return replace_sessions(latest(rows, "created_at", "id", n), datasets, users).orderBy(
        F.col("created_at").desc(), F.col("id").desc())


def used_up(limit: int) -> Column:
    """Whether the bytes reach a quota; a limit of 0 or less means there is none."""
    return F.col("bytes") >= limit if limit > 0 else F.lit(False)


def daily_quota(log: DataFrame, limit: int = PUBLIC_DAILY_BYTES) -> DataFrame:
    """Bytes served per UTC day, and whether the day's quota is used up."""
    # Days are those of UTC in any session zone: an instant is first written as its UTC time.
    instants = isinstance(log.schema["accessed_at"].dataType, T.TimestampType)
    at = utc_zoneless(F.col("accessed_at")) if instants else F.col("accessed_at")
    per_day = log.withColumn("accessed_at", at).groupBy(F.window("accessed_at", "1 day").alias("w")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests"))
    return per_day.select(
        (utc_instant(F.col("w.start")) if instants else F.col("w.start")).alias("day"),
        F.concat(F.lit(PUBLIC_QUOTA_KEY), F.date_format("w.start", "yyyyMMdd")).alias("quota_key"),
        "requests", "bytes", used_up(limit).alias("exceeded"))


def activity_slots(log: DataFrame, key: str, time: str, minutes: int, sums: Sequence[str] = ()) -> DataFrame:
    """Events per key and fixed slot of ``minutes``. Works on a log and on a stream of log rows."""
    slot = F.window(time, f"{minutes} minutes").alias("slot")
    return log.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key), slot).agg(
        F.count(F.lit(1)).alias("events"), F.min(time).alias("first_at"), F.max(time).alias("last_at"),
        *[F.sum(c).alias(c) for c in sums])


def numbered_runs(slots: DataFrame, key: str, minutes: int) -> DataFrame:
    """Slots with the number (``_run``) of the run they belong to: slots without a pause longer than ``minutes``."""
    gap = F.make_dt_interval(mins=F.lit(minutes))
    in_time = Window.partitionBy(key).orderBy("first_at")
    apart = F.col("first_at") > F.lag("last_at").over(in_time) + gap
    return slots.withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn(
        "_run", F.sum("_new").over(in_time.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chain_slots(slots: DataFrame, key: str, minutes: int, sums: Sequence[str] = ()) -> DataFrame:
    """Join slots without a pause longer than ``minutes`` between them into windows."""
    gap = F.make_dt_interval(mins=F.lit(minutes))
    return numbered_runs(slots, key, minutes).groupBy(key, "_run").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.sum("events").alias("events"), *[F.sum(c).alias(c) for c in sums]).select(
        key, F.col("first_at").alias("window_start"), (F.col("last_at") + gap).alias("window_end"),
        "events", *sums)


def inactivity_windows(log: DataFrame, key: str, time: str, minutes: int, sums: Sequence[str] = ()) -> DataFrame:
    """Runs of events of one key without a pause longer than ``minutes``.

    A pause of exactly that length still extends the run. Two events inside one fixed slot of that
    length can never be further apart, so a slot always belongs to one run. The log is therefore
    reduced to slots first (combined in each task before the shuffle, whatever the share of a hot
    key); only the slots, whose number depends on the time covered and not on the number of events,
    are chained per key.
    """
    return chain_slots(activity_slots(log, key, time, minutes, sums), key, minutes, sums)


def token_windows(log: DataFrame, limit: int = TOKEN_BYTES, minutes: int = TOKEN_WINDOW_MINUTES) -> DataFrame:
    """Quota windows per token: every served request extends the window it falls into."""
    minutes = minutes if minutes > 0 else TOKEN_WINDOW_MINUTES
    return inactivity_windows(log, "token_id", "accessed_at", minutes, ["bytes"]).withColumn(
        "exceeded", used_up(limit))


def token_quota(log: DataFrame, now, limit: int = TOKEN_BYTES, minutes: int = TOKEN_WINDOW_MINUTES) -> DataFrame:
    """State per token at ``now``: bytes in the open window, and whether the next call is refused."""
    seen = date_range(log, "accessed_at", None, now)
    open_now = F.col("window_end") >= instant(now, log.schema["accessed_at"].dataType)
    return token_windows(seen, limit, minutes).filter(open_now)


def attempt_windows(attempts: DataFrame, key: str, time: str, limit: int, minutes: int) -> DataFrame:
    """Attempt limiter: each attempt counts and extends; limited once the count passes the limit."""
    keyed = attempts.withColumn(key, F.lower(F.col(key).cast("string")))
    return inactivity_windows(keyed, key, time, minutes).withColumn("limited", F.col("events") > limit)


def download_counts(downloads: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Downloads per file; with ``files`` added to the stored counter."""
    counts = downloads.groupBy("file_id").agg(F.count(F.lit(1)).alias("new_downloads"))
    if files is None:
        return counts
    return files.select(F.col("id").alias("file_id"), "name", "downloads").join(counts, "file_id", "left").select(
        "file_id", "name", (F.col("downloads") + F.coalesce("new_downloads", F.lit(0))).alias("downloads"))


def total_upload_size(uploads: DataFrame, size: str = "size_bytes", *keys: str) -> DataFrame:
    return uploads.groupBy(*keys).agg(F.sum(size).alias("total_bytes"), F.count(F.lit(1)).alias("files"))


def valid_tokens(tokens: DataFrame, now, lifetime_hours: int = TOKEN_LIFETIME_HOURS) -> DataFrame:
    """Tokens neither revoked nor older than their lifetime at ``now``."""
    oldest = instant(now, tokens.schema["created_at"].dataType) - F.make_dt_interval(hours=F.lit(lifetime_hours))
    return tokens.filter(F.col("revoked_at").isNull() & (F.col("created_at") >= oldest))


def user_tokens(tokens: DataFrame, user_id: int) -> DataFrame:
    """Tokens of one user, newest first."""
    return tokens.filter(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), F.col("id").desc())


def expired_sessions(sessions: DataFrame, now, hours: int = SESSION_LIFETIME_HOURS) -> DataFrame:
    """Sessions past their lifetime that are neither aborted nor pushed."""
    cutoff = instant(now, sessions.schema["created_at"].dataType) - F.make_dt_interval(hours=F.lit(hours))
    return sessions.filter((F.col("created_at") <= cutoff) & ~F.col("status").isin(ABORTED, PUSHED))
