"""Zoneless UTC times and instants, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_zoneless(instant: Column) -> Column:
    """TIMESTAMP to the zoneless UTC time of the same instant."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def utc_instant(zoneless: Column) -> Column:
    """Zoneless UTC time to TIMESTAMP, as watermarks need it."""
    return F.concat(zoneless.cast("string"), F.lit("Z")).cast("timestamp")
