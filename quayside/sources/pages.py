"""Pages written as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.errors import RequestError
from quayside.storage import delete_path, move_path

# Rows per row group and bytes per response.
ROW_GROUP_ROWS = 10_000
MAX_BYTES = 200 * 1024 * 1024
# Room for the footer: its schema and, per row group and column, statistics with two cut-off values.
_FOOTER, _PER_COLUMN = 4096, 1024


def written_bytes(df_or_session, path: str) -> int:
    """Total size of the data files below ``path``."""
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def cell_bytes(cell: Column, kind: T.DataType) -> Column:
    """Most bytes that a cell takes before compression, with its share of levels and lengths."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(cell), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((cell_bytes(cell.getField(f.name), f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)):
        # Nested values have no plain bound: their text is longer than their bytes.
        return F.coalesce(F.octet_length(F.to_json(cell)), F.lit(0)).cast("long") * 4 + 16
    return F.lit(20).cast("long")


def most_bytes(page: DataFrame, rows_per_group: int) -> int:
    """An upper bound of the size of a page, without writing it."""
    row = sum((cell_bytes(F.col(f"`{f.name}`"), f.dataType) for f in page.schema.fields), F.lit(0).cast("long"))
    found = page.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).head()
    groups = -(-found["n"] // rows_per_group) + 1
    return found["bytes"] + _FOOTER + (groups + 1) * len(page.columns) * _PER_COLUMN


def write_page_parquet(page: DataFrame, path: str, rows_per_group: int = ROW_GROUP_ROWS,
                       max_bytes: int = MAX_BYTES) -> int:
    """Write a page as one file of row groups of ``rows_per_group`` rows; too large a page is an error.

    Returns the bytes written (the figure that counts against quotas). A page that is sure to fit by the sizes of its
    cells is written at once. Any other is written beside its place first, as it may shrink, and only moved there if it
    fits: a refused page leaves nothing. A page has a bounded number of rows, and Spark already brought its sorted rows
    together; they are kept for the two looks at them.
    """
    groups = max(1, rows_per_group)
    held = page.persist()
    try:
        sure = most_bytes(held, groups) <= max_bytes
        place = path if sure else f"{path.rstrip('/')}.{uuid.uuid4().hex}.draft"
        held.coalesce(1).write.option("parquet.block.row.count.limit", groups).parquet(place)
    finally:
        held.unpersist()
    size = written_bytes(page, place)
    if size > max_bytes:
        delete_path(page.sparkSession, place)
        raise RequestError("the page is larger than the size limit")
    if not sure:
        move_path(page.sparkSession, place, path)
    return size
