"""Load files into a table: one conversion job, published only when it succeeded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quayside import types as L
from quayside.errors import InputError
from quayside.operators.convert import (
    ImportResult, accept_gate, convert, drop_empty_rows, import_errors, result_aggregates)
from quayside.operators.rowindex import row_index, row_index_by_location, surrogate_key_name
from quayside.sources.tables import publish
from quayside.sources.tabular import FILE, FILE_SEQ, ROW_NO
from quayside.storage import fresh_path, job_folders, materialise, path_exists


def load_table(df: DataFrame, columns: Sequence[L.ColumnDef], table: str, on_errors: str = "fail",
               dense_key: bool = True, path: str | None = None,
               currency: str = "¤", purge: bool = False) -> tuple[ImportResult, DataFrame]:
    """Convert ``df``, write it to a fresh folder, and publish it as ``table``.

    Counts come from the write job itself (``observe``). The old table stays in place until the new
    data is complete and accepted; a ``path`` that exists is refused. Returns the counts and the rejects, which are
    written apart. A dense key costs one more write, of the converted rows;
    ``dense_key=False`` numbers the rows in the conversion job itself, with gaps. Of the folders made on the way only
    the table's and the rejects' stay, and after a failure none. ``purge`` also deletes the folder of the
    table that is replaced, once nobody reads it any more.
    """
    spark = df.sparkSession
    if path is not None and path_exists(spark, path):
        raise InputError("the folder of the new table exists already")
    names = [c.name for c in columns]
    key = surrogate_key_name(names)
    counts = Observation()
    converted = convert(df, columns, currency=currency)
    watched = converted.observe(counts, *result_aggregates(names))
    with job_folders(spark) as job:
        target = path or fresh_path(spark, "table-" + table.replace(".", "-"))
        job.made += [path] if path else []   # made by this call: it did not exist before
        if dense_key:
            staged = fresh_path(spark, "converted")
            watched.write.parquet(staged)
            converted = spark.read.schema(watched.schema).parquet(staged)
        else:
            keyed = drop_empty_rows(watched, names).withColumn(key, F.monotonically_increasing_id() + 1)
            keyed.select(key, *names).write.parquet(target)
        seen = counts.get
        result = ImportResult(seen["rows_read"], seen["rows_copied"], seen["empty_rows"], seen["errors"], True)
        accept_gate(result, on_errors)
        if dense_key:
            kept = drop_empty_rows(converted, names)
            if FILE_SEQ in kept.columns and ROW_NO in kept.columns:
                keyed = row_index_by_location(kept, [c for c in (FILE_SEQ, FILE) if c in kept.columns], ROW_NO, key)
            else:
                keyed = row_index(kept, (), key)
            keyed.select(key, *names).write.parquet(target)
        rejects = materialise(import_errors(converted), "rejects", keep=True)
        job.keep(target)
    publish(spark, table, target, keyed.select(key, *names).schema, {"quayside.key": key}, purge)
    return result, rejects
