"""Shared helpers of the operators: text batches, word splitting, stable folds, packed integer columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quayside.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Texts handed to one Python call; long texts make smaller calls.
CALL_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """``crc32(key as text) mod folds``: the fold that decides who is held out. A null key is in no fold."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text (``bytes.split`` splits on exactly these characters)."""
    return text.split()


def lower_words_of(text: bytes) -> list[bytes]:
    """The same with A-Z in lower case (``bytes.lower`` touches ASCII only)."""
    return text.lower().split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def calls(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that no cut holds much more than CALL_BYTES of ``name`` (one text is never cut)."""
    if not batch.num_rows:
        return
    sizes = np.frombuffer(batch.column(name).cast(pa.large_string()).buffers()[1], np.int64)
    sizes = np.diff(sizes[batch.column(name).offset : batch.column(name).offset + batch.num_rows + 1])
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CALL_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def in_workers(rows: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def map_texts(rows: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str | T.StructType,
              text: str = "text") -> DataFrame:
    """``mapInArrow`` over cuts of bounded size. ``make`` returns the columns of one cut, by name."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in calls(batch, text):
                yield to_batch(make(cut), target)

    return in_workers(rows, run, kind)


def filter_texts(rows: DataFrame, keep: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """Rows whose text passes ``keep``, with all their columns untouched, whatever their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in calls(batch, text):
                yield cut.filter(pa.array(keep(as_bytes(cut.column(text))), pa.bool_()))

    return in_workers(rows, run, rows.schema)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = [x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in target]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


_codecs: dict = {}


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Unsigned integers as compressed byte planes, as many as the largest value needs; the first byte is their number."""
    if level not in _codecs:
        _codecs[level] = zstandard.ZstdCompressor(level=level)
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    data = np.ascontiguousarray(values, dtype="<u4" if width <= 4 else "<u8")
    planes = data.view(np.uint8).reshape(len(data), -1)[:, :width].T
    return bytes([width]) + _codecs[level].compress(np.ascontiguousarray(planes))


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    if "d" not in _codecs:
        _codecs["d"] = zstandard.ZstdDecompressor()
    planes = np.frombuffer(_codecs["d"].decompress(data[1:]), np.uint8).reshape(data[0], -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : data[0]] = planes.T
    return whole.view("<u8").ravel()


class Memo(dict):
    """A bounded cache of a pure function; it forgets everything when it is full."""

    def __init__(self, function: Callable, entries: int):
        super().__init__()
        self.function, self.entries = function, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.function(key)
        return value
