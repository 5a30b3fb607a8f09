"""Tables exported as numbered CSV parts with a manifest."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.errors import InputError
from quayside.functions.render import render_all
from quayside.functions.text import truncate
from quayside.operators.rowindex import row_index, scan_row_index
from quayside.sources.tables import quoted
from quayside.storage import job_folders, materialise

# Rows per part and tracked warnings.
DEFAULT_ROWS_PER_PART = 1_000_000
MAX_ROWS_PER_PART = 5_000_000
MAX_WARNINGS = 100

_INDEX = "__row"
PART = "part"
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "compression": "none",
}


def checked_rows(rows_per_part: int) -> int:
    if not 1 <= rows_per_part <= MAX_ROWS_PER_PART:
        raise InputError(f"rows per part must be between 1 and {MAX_ROWS_PER_PART}")
    return rows_per_part


def number_parts(df: DataFrame, rows_per_part: int = DEFAULT_ROWS_PER_PART,
                 order: Sequence[str] = (), scan: bool = False) -> DataFrame:
    """Add the row index and the part number of every row.

    ``scan`` says that ``df`` is a whole Parquet table, to be numbered in stored order; that takes
    neither a shuffle nor a write.
    """
    size = checked_rows(rows_per_part)
    indexed = scan_row_index(df, _INDEX) if scan and not order else row_index(df, order, _INDEX)
    return indexed.withColumn(PART, F.floor((F.col(_INDEX) - 1) / F.lit(size)).cast("int") + 1)


def manifest_parts(numbered: DataFrame) -> DataFrame:
    """Per part: file name, number, rows, first and last row index."""
    return numbered.groupBy(PART).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(_INDEX).alias("first_row_index"),
        F.max(_INDEX).alias("last_row_index")).select(
        part_file(F.col(PART)).alias("file"), F.col(PART).alias("part_number"),
        "row_count", "first_row_index", "last_row_index")


def part_file(number):
    """``data_part001.csv``; more digits only when needed."""
    text = number.cast("string")
    return F.concat(F.lit("data_part"), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0")), F.lit(".csv"))


def manifest_totals(numbered: DataFrame) -> DataFrame:
    """Rows and parts of the whole export."""
    return numbered.agg(F.count(F.lit(1)).alias("total_row_count"),
                        F.greatest(F.countDistinct(PART), F.lit(1)).alias("parts"))


def export_csv_parts(df: DataFrame, path: str, rows_per_part: int = DEFAULT_ROWS_PER_PART,
                     order: Sequence[str] = (), info: dict | None = None, scan: bool = False) -> dict:
    """Write ``part=N/`` folders, each with one CSV file and its own header, and ``manifest.json``.

    A part has at most ``rows_per_part`` rows, which bounds the task that writes it. Rows go to their
    part in one shuffle, in index order. An empty table gives one part with the header only.
    """
    size = checked_rows(rows_per_part)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise InputError(f"column {field.name} is nested and has no CSV form")
    with job_folders(df.sparkSession):   # the numbered copy is read by nobody once the parts are written
        return _exported(df, path, size, order, info, scan)


def _exported(df: DataFrame, path: str, size: int, order: Sequence[str], info: dict | None, scan: bool) -> dict:
    numbered = number_parts(df, size, order, scan)
    # The one counting job; its rows, one per part, size the shuffle below.
    parts = materialise(manifest_parts(numbered), "export-parts")
    n_parts, total = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("row_count"), F.lit(0))).head()
    warnings, cut = [], False
    if not n_parts:
        render_all(df.limit(0)).coalesce(1).write.options(**CSV_OPTIONS).csv(f"{path}/{PART}=1")
        parts = df.sparkSession.createDataFrame(
            [("data_part001.csv", 1, 0, None, None)],
            "file string, part_number int, row_count long, first_row_index long, last_row_index long")
    else:
        placed = numbered.repartitionByRange(n_parts, PART).sortWithinPartitions(PART, _INDEX)
        rendered = render_all(placed, keep=(PART, _INDEX)).drop(_INDEX)
        rendered.write.options(**CSV_OPTIONS).partitionBy(PART).csv(path)
        odd = render_warnings(numbered)
        if odd is not None:
            shown, cut = warnings_report(odd)
            warnings = [x.asDict() for x in shown.collect()]
    manifest = {
        **(info or {}), "maxRowsPerPart": size,
        "generatedAtUtc": dt.datetime.now(dt.timezone.utc).isoformat(), "totalRowCount": total,
        "warnings": warnings, "warningsTruncated": cut,
    }
    # The part list has one line per part and is written by Spark next to the header document.
    parts.write.json(f"{path}/_manifest_parts")
    header = df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string")
    header.coalesce(1).write.text(f"{path}/_manifest")
    return manifest


def export_table(spark: SparkSession, table: str, path: str, rows_per_part: int = DEFAULT_ROWS_PER_PART,
                 info: dict | None = None) -> dict:
    """Export a whole Parquet table in stored order; only the step to the parts shuffles."""
    return export_csv_parts(spark.table(quoted(table)), path, rows_per_part, (), {"table": table, **(info or {})}, scan=True)


def render_warnings(numbered: DataFrame) -> DataFrame | None:
    """Cells whose text is no number any more: infinities and NaN. None if no column can hold them."""
    floats = [f.name for f in numbered.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return None
    odd = [F.when(F.isnan(f"`{c}`") | (F.abs(F.col(f"`{c}`")) == float("inf")),
                  F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))) for c in floats]
    found = numbered.select(F.col(_INDEX).alias("row_index"), F.explode(F.array_compact(F.array(*odd))).alias("w"))
    return found.select("row_index", "w.column_name", truncate(F.col("w.value"), 200).alias("value"),
                        F.lit("the value is not a finite number").alias("message"))


def warnings_report(warnings: DataFrame, limit: int = MAX_WARNINGS) -> tuple[DataFrame, bool]:
    """The first warnings by row and column, and whether there were more."""
    shown = warnings.orderBy("row_index", "column_name").limit(limit + 1)
    return shown.limit(limit), shown.count() > limit
