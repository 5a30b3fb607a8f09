"""Header rules shared by imports and replace chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.errors import InputError
from quayside.functions.parsing import BLANKS


def trim_headers(header: Sequence[str | None]) -> list[str]:
    return [(h or "").lstrip("\ufeff").strip(BLANKS) for h in header]


def check_headers_unique(header: Sequence[str]) -> None:
    """No two names may differ by case only."""
    repeated = [name for name, n in Counter(h.lower() for h in header).items() if n > 1]
    if repeated:
        raise InputError(f"column headers must be unique: {', '.join(sorted(repeated))}")


def duplicate_headers(headers: DataFrame, name: str = "name") -> DataFrame:
    """The same rule over a DataFrame of header names: the repeated ones and how often they occur."""
    return headers.groupBy(F.lower(name).alias("header")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_headers_positional(expected: Sequence[str], found: Sequence[str], label: str = "imported") -> None:
    """Same names in the same order, any case."""
    if [h.lower() for h in expected] != [h.lower() for h in found]:
        raise InputError(f"the {label} files must share the same columns")


def align_by_name(df: DataFrame, target: Sequence[str]) -> DataFrame:
    """Reorder to the target's columns; the name sets must agree, any case and any order."""
    found = trim_headers(df.columns)
    check_headers_unique(found)
    by_name = {h.lower(): c for h, c in zip(found, df.columns)}
    if len(found) != len(target) or set(by_name) != {t.lower() for t in target}:
        raise InputError("the Parquet files must share the same columns as the selected schema")
    return df.select(*[F.col(f"`{by_name[t.lower()]}`").alias(t) for t in target])
