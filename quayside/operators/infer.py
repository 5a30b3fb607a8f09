"""Column types inferred from text, in one aggregation over all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import types as L
from quayside.functions.parsing import FIT_BITS, fit_mask, trimmed
from quayside.sources.tabular import as_text, data_columns, head_rows, read_tabular

# Precedence of the inferred types; text is left when none fits.
PRECEDENCE = (L.BIT, L.DATE_TIME, L.INT, L.BIG_INT, L.DECIMAL, L.FLOAT)


def sample_rows(df: DataFrame, n: int | None, order: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows in file order when the rows carry their place, else any ``n`` rows."""
    if n is None:
        return df
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def resolve_type(fits: dict[str, Column], has_value: Column) -> Column:
    """Name of the first type every value fits; text when there is no value."""
    resolved = F.lit(L.TEXT)
    for logical in reversed(PRECEDENCE):
        resolved = F.when(fits[logical], F.lit(logical)).otherwise(resolved)
    return F.when(has_value, resolved).otherwise(F.lit(L.TEXT))


def text_length(observed: Column) -> Column:
    return F.greatest(F.coalesce(observed, F.lit(0)), F.lit(L.DEFAULT_TEXT_LENGTH))


def inference_report(df: DataFrame, columns: Sequence[str] | None = None,
                     currency: str = "¤") -> DataFrame:
    """One row per column: which types every non-blank value fits, and the resolved type.

    Cells become rows of (column number, text), so that the tests stand once in the generated code and are compiled,
    however many columns there are. Each task reduces them to one row per column: the only thing shuffled.
    """
    columns = list(columns or df.columns)
    cells = as_text(df.select(*[F.col(f"`{c}`") for c in columns]), columns)
    texts = cells.select(F.posexplode(F.array(*[trimmed(F.col(f"`{c}`")) for c in columns])).alias("at", "text"))
    # A blank cell is NULL, and aggregates leave NULLs out.
    reduced = texts.withColumn("mask", fit_mask(F.col("text"), currency)).groupBy("at").agg(
        F.count("text").alias("n_values"), F.max(F.length("text")).alias("max_length"), F.bit_and("mask").alias("mask"))
    # One row per column is left; a table without rows has its columns all the same.
    seen = reduced.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("n_values", "max_length", "mask")))).alias("seen"))
    long = seen.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"), F.try_element_at("seen", F.lit(i)).alias("seen"))
        for i, name in enumerate(columns)])).alias("r")).select("r.ordinal", "r.column_name", "r.seen.*").withColumn(
        "n_values", F.coalesce("n_values", F.lit(0)))
    has_value = F.col("n_values") > 0
    flags = {logical: F.coalesce(F.col("mask").bitwiseAND(FIT_BITS[logical]) > 0, F.lit(False))
             for logical in PRECEDENCE}
    logical = resolve_type(flags, has_value)
    return long.select(
        "ordinal", "column_name", has_value.alias("has_value"),
        flags[L.BIT].alias("fits_bit"), flags[L.DATE_TIME].alias("fits_datetime"),
        flags[L.INT].alias("fits_int"), flags[L.BIG_INT].alias("fits_bigint"),
        flags[L.DECIMAL].alias("fits_decimal"), flags[L.FLOAT].alias("fits_float"),
        F.coalesce("max_length", F.lit(0)).alias("observed_length"),
        logical.alias("logical_type"),
        F.when(logical == L.TEXT, text_length(F.col("max_length"))).alias("max_length"))


def infer_columns(df: DataFrame, columns: Sequence[str] | None = None, sample: int | None = None,
                  order: Sequence[str] = (), currency: str = "¤") -> list[L.ColumnDef]:
    """Column definitions of text rows, from all of them or, if asked for, from a ``sample`` of first rows.

    A sample is a guess: later cells that do not fit become rejects. Taking the first rows of an already staged
    input sorts all of it; ``infer_files`` samples the files themselves instead.
    """
    columns = list(columns or [c for c in df.columns if c not in order])
    report = inference_report(sample_rows(df, sample, order), columns, currency)
    rows = report.orderBy("ordinal").collect()   # one row per column
    return [L.ColumnDef(r["column_name"], r["logical_type"], r["max_length"]) for r in rows]


def infer_files(spark: SparkSession, paths: Sequence[str], sample: int | None = None,
                currency: str = "¤") -> list[L.ColumnDef]:
    """Column definitions of files: from every row, or from ``sample`` first rows without reading the rest."""
    if sample is None:
        rows = read_tabular(spark, paths)
        return infer_columns(rows, data_columns(rows), currency=currency)
    return infer_columns(head_rows(spark, paths, sample), currency=currency)


def apply_overrides(inferred: Sequence[L.ColumnDef], types: dict[str, str] | None = None,
                    lengths: dict[str, int] | None = None) -> list[L.ColumnDef]:
    """The user's types and lengths over the inferred ones; an unknown type means text."""
    result = []
    for column in inferred:
        logical = (types or {}).get(column.name, column.logical)
        if logical not in L.LOGICAL_TYPES:
            logical = L.TEXT
        length = None
        if logical == L.TEXT:
            asked = (lengths or {}).get(column.name)
            length = next((n for n in (asked, column.length) if n and n > 0), L.DEFAULT_TEXT_LENGTH)
        result.append(L.ColumnDef(column.name, logical, length))
    return result


def index_column_candidates(columns: Sequence[L.ColumnDef]) -> dict[str, list[str]]:
    """Columns offered as time, id and include column of an index."""
    typed = [c for c in columns if c.logical != L.TEXT]
    return {
        "time": [c.name for c in typed if c.logical == L.DATE_TIME],
        "id": [c.name for c in typed if c.logical != L.DATE_TIME],
        "include": [c.name for c in typed],
    }
