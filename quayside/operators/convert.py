"""Text rows to typed rows, with every failed cell kept as a reject."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside import types as L
from quayside.errors import InputError
from quayside.functions.parsing import CHUNK, IMPORT, parse_text, trimmed
from quayside.functions.render import render_value
from quayside.sources.tabular import FILE, LOCATION, ROW_NO

ERRORS = "_errors"
DISPLAYED_ERRORS = 200

# Messages per logical type, for file imports and for replace chunks.
MESSAGES = {
    IMPORT: {
        L.BIT: "Cannot convert value to bit; stored as NULL.",
        L.INT: "Cannot convert value to int; stored as NULL.",
        L.BIG_INT: "Cannot convert value to bigint; stored as NULL.",
        L.DECIMAL: "Cannot convert value to decimal; stored as NULL.",
        L.FLOAT: "Cannot convert value to float; stored as NULL.",
        L.DATE_TIME: "Cannot convert value to datetime2; stored as NULL.",
    },
    CHUNK: {
        L.BIT: "Value must be a boolean.",
        L.INT: "Value must be an integer.",
        L.BIG_INT: "Value must be a 64-bit integer.",
        L.DECIMAL: "Value must be a decimal number.",
        L.FLOAT: "Value must be a floating-point number.",
        L.DATE_TIME: "Value must be a valid date/time.",
    },
}

# Native types that become a logical type by a plain cast, without a detour over text.
_DIRECT = {
    L.BIT: (T.BooleanType,),
    L.INT: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    L.BIG_INT: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    L.DECIMAL: (T.DecimalType, T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    L.FLOAT: (T.FloatType, T.DoubleType),
    L.DATE_TIME: (T.TimestampNTZType, T.DateType),
}


def convert_cell(cell: Column, source: T.DataType, logical: str, grammar: str = IMPORT,
                 currency: str = "¤") -> Column:
    """Typed value of one cell; NULL when it is blank or does not fit."""
    if _is_direct(source, logical):
        return cell.try_cast(L.SPARK_TYPES[logical])
    return parse_text(cell_text(cell, source), logical, grammar, currency)


def _is_direct(source: T.DataType, logical: str) -> bool:
    return isinstance(source, _DIRECT.get(logical, ()))


def cell_text(cell: Column, source: T.DataType) -> Column:
    """Trimmed text of a cell of any type; NULL when blank."""
    return trimmed(cell if isinstance(source, T.StringType) else render_value(cell, source))


def convert(df: DataFrame, columns: Sequence[L.ColumnDef], grammar: str = IMPORT,
            currency: str = "¤") -> DataFrame:
    """Typed columns, the carried row location, and ``_errors``: one entry per failed cell.

    ``df`` holds the same columns by position. The first projection trims each cell once, the second
    types it, the third compares both; all of it runs in one stage, without a shuffle or Python.
    """
    carried = [c for c in LOCATION if c in df.columns]
    sources = [f for f in df.schema.fields if f.name not in LOCATION]
    if len(sources) != len(columns):
        raise InputError("the files must share the same columns as the selected schema")
    pairs = list(enumerate(zip(sources, columns)))
    parsed = [i for i, (f, c) in pairs if not _is_direct(f.dataType, c.logical)]
    checked = [i for i, (f, c) in pairs if c.logical != L.TEXT and f.dataType != L.SPARK_TYPES[c.logical]]
    texts = df.select(
        *[cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f"_text{i}") for i, (f, _) in pairs
          if i in parsed or i in checked],
        *[F.col(f"`{f.name}`").alias(f"_cell{i}") for i, (f, _) in pairs if i not in parsed],
        *carried)
    typed = texts.select(
        *[(parse_text(F.col(f"_text{i}"), c.logical, grammar, currency) if i in parsed
           else F.col(f"_cell{i}").try_cast(L.SPARK_TYPES[c.logical]))
          .alias(c.name, metadata=c.field().metadata) for i, (_, c) in pairs],
        *[f"_text{i}" for i in checked], *carried)
    failures = [
        F.when(F.col(f"_text{i}").isNotNull() & F.col(f"`{columns[i].name}`").isNull(), F.struct(
            F.lit(columns[i].name).alias("column_name"), F.col(f"_text{i}").alias("raw_value"),
            F.lit(MESSAGES[grammar][columns[i].logical]).alias("message")))
        for i in checked
    ]
    none = F.array().cast("array<struct<column_name:string,raw_value:string,message:string>>")
    errors = F.array_compact(F.array(*failures)) if failures else none
    return typed.select(*[F.col(f"`{c.name}`") for c in columns], *carried, errors.alias(ERRORS))


def empty_row(names: Sequence[str]) -> Column:
    """True for a row without any converted value."""
    found = F.coalesce(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(True)) for n in names])
    return found.isNull()


def drop_empty_rows(converted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Leave out rows where every cell is NULL, failed cells included."""
    return converted.dropna(how="all", subset=list(names))


def import_errors(converted: DataFrame) -> DataFrame:
    """All rejects: (file, row, column, raw value, message)."""
    place = [F.col(c).alias(name) for c, name in ((FILE, "file_name"), (ROW_NO, "row_number"))
             if c in converted.columns]
    # The outer form keeps the optimizer from testing for an empty list first, which would convert
    # every cell a second time.
    rows = converted.select(*place, F.explode_outer(ERRORS).alias("e")).filter(F.col("e").isNotNull())
    return rows.select(*[c for c in rows.columns if c != "e"], "e.*")


def displayed_errors(errors: DataFrame, n: int = DISPLAYED_ERRORS) -> DataFrame:
    """The first rejects in file and row order, for display only."""
    order = [c for c in ("file_name", "row_number", "column_name") if c in errors.columns]
    return errors.orderBy(*order).limit(n)


@dataclass(frozen=True)
class ImportResult:
    rows_read: int
    rows_copied: int
    empty_rows: int
    errors: int
    table_created: bool = False


def result_aggregates(names: Sequence[str]) -> list[Column]:
    empty = empty_row(names)
    return [
        F.count(F.lit(1)).alias("rows_read"),
        F.count(F.when(~empty, 1)).alias("rows_copied"),
        F.count(F.when(empty, 1)).alias("empty_rows"),
        F.coalesce(F.sum(F.size(ERRORS)), F.lit(0)).cast("bigint").alias("errors"),
    ]


def import_result(converted: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of counts. A write job gets the same counts for free from ``observe``."""
    return converted.agg(*result_aggregates(names))


def accept_gate(result: ImportResult, on_errors: str = "fail") -> ImportResult:
    """``fail`` refuses a load with rejects; ``null`` keeps it, the bad cells being NULL."""
    if on_errors not in ("fail", "null"):
        raise InputError("on_errors must be 'fail' or 'null'")
    if result.errors and on_errors == "fail":
        raise InputError(f"{result.errors} cells could not be converted")
    return result
