"""Time, id and value slices, and stable keyset pages over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.errors import RequestError
from quayside.functions.literals import as_literal, cursor_decode, cursor_encode, parse_literal
from quayside.operators.rowindex import row_index
from quayside.storage import sized_partitions

# Page size limits.
MAX_ROWS_PER_PAGE = 100_000


@dataclass(frozen=True)
class IndexColumns:
    """Columns a table is sliced by; the key makes the order total."""

    time: str
    key: str
    id: str | None = None
    include: str | None = None

    def order(self, with_include: bool = False) -> list[str]:
        names = [self.id, self.time, self.include if with_include else None, self.key]
        return list(dict.fromkeys(n for n in names if n))


def check_limit(limit: int | None, maximum: int = MAX_ROWS_PER_PAGE) -> int:
    if limit is None:
        raise RequestError("a page needs a limit")
    if not 1 <= limit <= maximum:
        raise RequestError(f"the limit of a page lies between 1 and {maximum}")
    return limit


def _typed(df: DataFrame, column: str, value):
    return parse_literal(value, df.schema[column].dataType) if isinstance(value, str) and not isinstance(
        df.schema[column].dataType, T.StringType) else value


def time_slice(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows between two times, both ends included, either one optional."""
    low, high = _typed(df, column, start), _typed(df, column, end)
    if low is not None and high is not None and low > high:
        raise RequestError("the start of a slice lies after its end")
    kind = df.schema[column].dataType
    if low is not None:
        df = df.filter(F.col(column) >= as_literal(low, kind))
    if high is not None:
        df = df.filter(F.col(column) <= as_literal(high, kind))
    return df


def id_slice(df: DataFrame, column: str | None, value) -> DataFrame:
    """Rows of one id; refused for a table without an id column."""
    if value is None:
        return df
    if not column:
        raise RequestError("the table has no id column to slice by")
    return df.filter(F.col(column) == as_literal(_typed(df, column, value), df.schema[column].dataType))


def slice_rows(df: DataFrame, index: IndexColumns, start=None, end=None, id_value=None) -> DataFrame:
    return id_slice(time_slice(df, index.time, start, end), index.id, id_value)


def include_slice(df: DataFrame, index: IndexColumns, value=None, start=None, end=None,
                  id_value=None, with_key: bool = False) -> DataFrame:
    """Rows with one include value; only id, time and include are read (and the key for paging)."""
    if not index.include:
        raise RequestError("the table has no include column to slice by")
    rows = slice_rows(df, index, start, end, id_value)
    if value is not None:
        kind = df.schema[index.include].dataType
        rows = rows.filter(F.col(index.include) == as_literal(_typed(df, index.include, value), kind))
    names = [index.id, index.time, index.include] + ([index.key] if with_key else [])
    return project_distinct_columns(rows, names)


def project_distinct_columns(df: DataFrame, columns: Sequence[str | None]) -> DataFrame:
    """Named columns without blanks and repeats; all columns when none is named."""
    names = list(dict.fromkeys(c for c in columns if c and c.strip()))
    return df.select(*names) if names else df


# --------------------------------------------------------------------------------------------- pages

def after_cursor(df: DataFrame, keys: Sequence[str], values: Sequence | None) -> DataFrame:
    """Rows after the cursor in ascending key order, NULL keys first.

    The condition on the first key is repeated on its own, so that row groups below the cursor are
    skipped by their statistics.
    """
    if values is None:
        return df
    kinds = [df.schema[k].dataType for k in keys]
    branches = []
    for i, key in enumerate(keys):
        same = [F.col(k).isNull() if v is None else F.col(k) == as_literal(v, t)
                for k, v, t in zip(keys[:i], values, kinds)]
        beyond = F.col(key).isNotNull() if values[i] is None else F.col(key) > as_literal(values[i], kinds[i])
        branches.append(reduce(Column.__and__, [*same, beyond]))
    rows = df.filter(reduce(Column.__or__, branches))
    if values[0] is not None:
        rows = rows.filter(F.col(keys[0]) >= as_literal(values[0], kinds[0]))
    return rows


def keyset_page(df: DataFrame, keys: Sequence[str], limit: int, cursor: str | None = None,
                bound: Sequence | None = None) -> DataFrame:
    """One page in key order. ``bound`` (see ``page_bound``) stops the scan early; it drops no row
    of the page."""
    check_limit(limit)
    return _ordered_head(df, keys, limit, cursor, bound)


def _ordered_head(df: DataFrame, keys: Sequence[str], n: int, cursor: str | None,
                  bound: Sequence | None) -> DataFrame:
    values = cursor_decode(cursor, [df.schema[k] for k in keys]) if cursor else None
    rows = after_cursor(df, keys, values)
    if bound is not None:
        rows = rows.filter(F.col(keys[0]).isNull() | (
            F.col(keys[0]) <= as_literal(bound[0], df.schema[keys[0]].dataType)))
    return rows.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(n)


@dataclass(frozen=True)
class PageInfo:
    row_count: int
    has_more: bool
    next_cursor: str


def page_info_frame(df: DataFrame, keys: Sequence[str], limit: int, cursor: str | None = None,
                    bound: Sequence | None = None) -> DataFrame:
    """Size of the page, whether more rows follow, and the last key; only key columns are read.

    At most ``limit + 1`` keys meet in the final step.
    """
    check_limit(limit)
    head = _ordered_head(df.select(*keys), keys, limit + 1, cursor, bound)
    seen = head.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("k"))
    n = F.least(F.size("k"), F.lit(limit))
    return seen.select(
        n.alias("row_count"), (F.size("k") > limit).alias("has_more"),
        F.when(n > 0, F.get(F.col("k"), n - 1)).alias("last_key")
    ).select("row_count", "has_more", *[F.col(f"last_key.{k}").alias(f"last_{k}") for k in keys])


def page_info(df: DataFrame, keys: Sequence[str], limit: int, cursor: str | None = None,
              bound: Sequence | None = None) -> PageInfo:
    row = page_info_frame(df, keys, limit, cursor, bound).head()
    more = row["has_more"]
    following = cursor_encode([row[f"last_{k}"] for k in keys]) if more else ""
    return PageInfo(row["row_count"], more, following)


def scan_pages(df: DataFrame, keys: Sequence[str], limit: int):
    """All pages in turn, as an API client reads them. Spark jobs read the table instead."""
    cursor = None
    while True:
        info = page_info(df, keys, limit, cursor)
        if info.row_count:
            yield keyset_page(df, keys, limit, cursor)
        if not info.has_more:
            return
        cursor = info.next_cursor


def all_pages(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Every row with the number of the page a client would find it on, in one distributed job."""
    check_limit(limit)
    indexed = row_index(df, [F.col(k).asc_nulls_first() for k in keys], "_row")
    return indexed.withColumn("page", F.floor((F.col("_row") - 1) / F.lit(limit)).cast("int") + 1).drop("_row")


# -------------------------------------------------------------------------------------------- layout

def default_index_name(table: str, id_column: str | None) -> str:
    return f"IX_{table}_{'id_time' if id_column else 'time'}"


def clustered(df: DataFrame, index: IndexColumns, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by (id,) time and key, ready to be written.

    The key takes part in the ranges, so one id with a third of all rows is spread over many files.
    Statistics of the written files then let Spark skip everything outside a slice.
    """
    order = index.order()
    return df.repartitionByRange(partitions or sized_partitions(df), *order).sortWithinPartitions(*order)


def write_clustered(df: DataFrame, index: IndexColumns, path: str, partitions: int | None = None,
                    rows_per_file: int = 0) -> None:
    clustered(df, index, partitions).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def zone_map(df: DataFrame, index: IndexColumns) -> DataFrame:
    """Per file: rows and the range of each index column. One small row per file."""
    names = [c for c in (index.id, index.time) if c]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"min_{c}") for c in names],
        *[F.max(c).alias(f"max_{c}") for c in names],
        *[F.count(c).alias(f"count_{c}") for c in names])


def page_bound(zones: DataFrame, index: IndexColumns, limit: int, cursor_first=None,
               start=None, end=None, id_value=None) -> list | None:
    """An upper bound of the first key that still leaves a full page (and one row more).

    Only files whose every row belongs to the slice and lies beyond the cursor are counted; files in
    order of their highest key are added up until they hold ``limit + 1`` rows. The page cannot reach
    beyond the highest key of those files. NULL when too few rows are certain: then nothing is cut.
    """
    first = index.id or index.time
    sure = zones.filter(F.col(f"count_{first}") == F.col("n"))
    if id_value is not None:
        sure = sure.filter((F.col(f"min_{index.id}") == id_value) & (F.col(f"max_{index.id}") == id_value))
    if start is not None:
        sure = sure.filter(F.col(f"min_{index.time}") >= F.lit(start))
    if end is not None:
        sure = sure.filter(F.col(f"max_{index.time}") <= F.lit(end))
    if start is not None or end is not None:
        sure = sure.filter(F.col(f"count_{index.time}") == F.col("n"))
    if cursor_first is not None:
        sure = sure.filter(F.col(f"min_{first}") > F.lit(cursor_first))
    by_key = Window.orderBy(f"max_{first}", "file").rowsBetween(Window.unboundedPreceding, 0)
    held = sure.withColumn("held", F.sum("n").over(by_key)).filter(F.col("held") > limit)
    row = held.agg(F.min(f"max_{first}").alias("bound")).head()
    return None if row["bound"] is None else [row["bound"]]
