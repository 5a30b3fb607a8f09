"""Sizes written as text, such as ``12.5 GB`` (1024-based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and the power of 1024 of each.
UNITS = (("B", 0), ("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4))
_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _amount_and_power(text: Column) -> tuple[Column, Column]:
    parts = F.split(F.btrim(text), " +")
    well_formed = F.size(parts) == 2
    number = F.get(parts, F.lit(0))
    unit = F.upper(F.get(parts, F.lit(1)))
    amount = F.when(well_formed & number.rlike(_PLAIN), number.try_cast("double"))
    power = F.lit(None).cast("int")
    for name, exponent in reversed(UNITS):
        power = F.when(unit == name, F.lit(exponent)).otherwise(power)
    return amount, power


def parse_size_mb(text: Column) -> Column:
    """Size in megabytes; NULL for anything but ``number unit``."""
    amount, power = _amount_and_power(text)
    return amount * F.pow(F.lit(1024.0), power - 2)


def parse_size_bytes(text: Column) -> Column:
    """Size in whole bytes (fraction dropped); 0 for anything but ``number unit``."""
    amount, power = _amount_and_power(text)
    return F.coalesce((amount * F.pow(F.lit(1024.0), power)).try_cast("bigint"), F.lit(0).cast("bigint"))


def format_size(size: Column) -> Column:
    """Bytes as ``n B``, ``x.x KB``, ``x.x MB`` or ``x.x GB``."""
    kb, mb, gb = (size / F.lit(float(1024 ** p)) for p in (1, 2, 3))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(kb < 1024, F.format_string("%.1f KB", kb))
        .when(mb < 1024, F.format_string("%.1f MB", mb))
        .when(size.isNotNull(), F.format_string("%.1f GB", gb))
    )
