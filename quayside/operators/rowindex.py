"""Dense row numbers without a one-task window.

The rows are fixed first (written once, see ``storage``), together with the task that wrote them and
their position inside it. A second, tiny job counts the rows per task; the running sum of those
counts turns (task, position) into 1..n. Nothing but one number per task ever meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.storage import materialise, sized_partitions

_TASK = "__task"
_POSITION = "__position"
# monotonically_increasing_id() keeps the partition number above this bit.
_POSITION_BITS = 33
# One offset per task is broadcast up to this many tasks; beyond it Spark joins by shuffle.
MAX_BROADCAST_OFFSETS = 200_000
# Rows per block of ``row_index_by_location``.
BLOCK_ROWS = 1_000_000


def _as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def offset_table(counts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, offset)`` from ``(keys, n)``: rows before each group in key order.

    ``counts`` has one row per task or block. The window below runs over those few rows only; the
    result is rebuilt as a local relation, so its size is known exactly before it is broadcast.
    """
    before = F.coalesce(
        F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, before.alias("offset"))
    rows = offsets.take(MAX_BROADCAST_OFFSETS + 1)
    if len(rows) > MAX_BROADCAST_OFFSETS:
        return offsets
    return F.broadcast(counts.sparkSession.createDataFrame(rows, offsets.schema))


def row_index(df: DataFrame, order: Sequence[str | Column] = (), name: str = "row_index") -> DataFrame:
    """Add a dense 1..n index in ``order`` (or in write order when no order is given).

    With an order the rows are range-partitioned on *all* order columns, so a hot leading value is
    split by the columns after it; end the order with a unique column to make the result total.
    """
    keys = _as_columns(order)
    if keys:
        df = df.repartitionByRange(sized_partitions(df), *keys).sortWithinPartitions(*keys)
    numbered = df.withColumn(_POSITION, F.monotonically_increasing_id())
    numbered = numbered.withColumn(_TASK, F.shiftright(F.col(_POSITION), _POSITION_BITS).cast("int"))
    numbered = numbered.withColumn(
        _POSITION, F.col(_POSITION).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    fixed = materialise(numbered, "row-index")
    counts = fixed.groupBy(_TASK).agg(F.count(F.lit(1)).alias("n"))
    offsets = offset_table(counts, _TASK)
    indexed = fixed.join(offsets, _TASK, "inner")
    return indexed.withColumn(name, F.col("offset") + F.col(_POSITION) + 1).drop(
        _TASK, _POSITION, "offset")


def row_index_by_location(df: DataFrame, files: Sequence[str], row_no: str, name: str = "row_index") -> DataFrame:
    """Dense 1..n index in (file, row number) order for rows that carry their place.

    Row numbers cut every file into blocks of a fixed size, so the shuffle needs no sampling, every
    window is small whatever the size of a file, and a second evaluation gives the same numbers.
    """
    block = [*files, _TASK]
    blocked = df.withColumn(_TASK, F.floor(F.col(row_no) / F.lit(BLOCK_ROWS)))
    offsets = offset_table(blocked.groupBy(*block).agg(F.count(F.lit(1)).alias("n")), *block)
    place = F.row_number().over(Window.partitionBy(*block).orderBy(row_no))
    return blocked.withColumn(_POSITION, place).join(offsets, block).withColumn(
        name, F.col("offset") + F.col(_POSITION)).drop(_TASK, _POSITION, "offset")


def scan_row_index(table: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 1..n index of a whole Parquet table in stored order: file after file, row after row.

    ``table`` must be the bare scan, unfiltered. The reader knows the row's place in its file, so
    nothing is sorted, shuffled or written; the rows per file come from the file footers.
    """
    file, place = "__file", "__place"
    placed = table.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    offsets = offset_table(placed.groupBy(file).agg(F.count(F.lit(1)).alias("n")), file)
    return placed.join(offsets, file).withColumn(name, F.col("offset") + F.col(place) + 1).drop(file, place, "offset")


def surrogate_key_name(columns: Sequence[str]) -> str:
    """``Id``, or ``MyPK_id`` when the table already has a column of that name (any case)."""
    return "MyPK_id" if any(c.lower() == "id" for c in columns) else "Id"


def add_surrogate_key(df: DataFrame, order: Sequence[str] = (), dense: bool = True,
                      data_columns: Sequence[str] | None = None) -> DataFrame:
    """Put a generated key first: 1..n when ``dense``, else unique and increasing but with gaps."""
    key = surrogate_key_name(data_columns if data_columns is not None else df.columns)
    if dense:
        keyed = row_index(df, order, key)
    else:
        if order:
            keys = _as_columns(order)
            df = df.repartitionByRange(sized_partitions(df), *keys).sortWithinPartitions(*keys)
        keyed = df.withColumn(key, F.monotonically_increasing_id() + 1)
    return keyed.select(key, *[F.col(f"`{c}`") for c in df.columns])
