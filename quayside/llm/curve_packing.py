"""Packing along a space-filling curve.

Each document's token counts are hashed to a vector, the vector is projected to three dimensions, and the documents
are sorted by their Hilbert key, so that neighbours on the curve talk about alike things. The token stream in this
order is cut every ``length`` tokens: every sequence but the last one of all is full.

The ids are made once and written; only ids of rows, keys and counts are sorted; positions are sums of counts within
a sorted partition plus the totals of the partitions before it (one number per partition on the driver).

Cases: a null or empty text is the end id alone; equal keys are ordered by id, so copies spread over partitions;
repeated rows and null ids are packed like any other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Memo, as_bytes, in_workers, map_texts, pack, unpack
from quayside.llm.pretokens import PreTokens, tokenizer_at
from quayside.storage import materialise

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 2
BUCKETS, DIMENSIONS, CURVE_BITS = 1024, 3, 16
MEMO_CHUNKS, MEMO_PIECES = 500_000, 1_000_000


class ChunkIds:
    """Token ids of one chunk, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        tokenizer = tokenizer_at(path)
        self.encode, self.pre_tokens, merge = tokenizer.encode, PreTokens(path), tokenizer.model.tokenize
        stored = np.arange(tokenizer.get_vocab_size(), dtype="<u4").tobytes()
        self.ids = Memo(lambda piece: b"".join([stored[4 * x.id : 4 * x.id + 4] for x in merge(piece)]), MEMO_PIECES).__getitem__

    def __call__(self, chunk: bytes) -> bytes:
        pieces = self.pre_tokens(chunk)
        if pieces is None:
            return np.array(self.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.ids, pieces))


_chunks: dict = {}


def projection() -> np.ndarray:
    return np.random.default_rng(0).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def coordinates(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projection of the hashed, damped and normed count vector."""
    buckets = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    vector = np.log1p(np.bincount(buckets, minlength=BUCKETS)).astype(np.float32)
    return (vector @ matrix) / max(float(np.sqrt(vector @ vector)), 1e-9)


def hilbert_key(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (unsigned, below ``2 ** bits``), after Skilling (2004)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> bit) & 1)
    return key


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, tokens, place, ids`` of every document, written once."""
    def make(batch: pa.RecordBatch) -> dict:
        if path not in _chunks:
            _chunks[path] = Memo(ChunkIds(path), MEMO_CHUNKS)
        of, matrix, end = _chunks[path].__getitem__, projection(), np.array([end_id], "<u4").tobytes()
        tokens, places, packed = [], [], []
        for text in as_bytes(batch.column("text")):
            ids = np.frombuffer(b"".join(map(of, text.split())) + end, "<u4")
            tokens.append(len(ids))
            places.append(coordinates(ids, matrix).tolist())
            packed.append(pack(ids))
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "tokens": tokens, "place": places, "ids": packed}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"),
                       docs[text_col].alias("text"))
    return materialise(map_texts(rows, make, "row long, doc_id long, tokens long, place array<float>, ids binary"), "packing-ids")


def curve_order(rows: DataFrame) -> DataFrame:
    """``row, part, begin``: partition on the curve and tokens before the row in it. Coordinates are scaled by their
    mean and deviation over all rows and squeezed to the cells of the curve."""
    axes = [F.col("place")[i].cast("double") for i in range(DIMENSIONS)]
    scale = rows.select(*[f(x).alias(f"s{i}{j}") for i, x in enumerate(axes) for j, f in enumerate((F.avg, F.stddev_pop))]).first()
    cells = [F.floor(F.lit(2**CURVE_BITS - 1) / (1 + F.exp(-1.7 * (x - F.lit(scale[2 * i] or 0.0)) / F.lit(max(scale[2 * i + 1] or 0.0, 1e-9)))))
             for i, x in enumerate(axes)]
    light = rows.select("row", "doc_id", "tokens", *[x.cast("long").alias(f"c{i}") for i, x in enumerate(cells)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(DIMENSIONS)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("tokens"),
                                              pa.array(hilbert_key(grid))], ["row", "doc_id", "tokens", "key"])

    keys = in_workers(light, keyed, "row long, doc_id long, tokens long, key long")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = keys.repartitionByRange(tasks, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            begins = before + np.cumsum(tokens) - tokens
            before += int(tokens.sum())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(tokens), part, np.int32)), pa.array(begins),
                                              batch.column("tokens")], ["row", "part", "begin", "size"])

    return materialise(in_workers(along, summed, "row long, part int, begin long, size long"), "packing-order")


def pack_along_curve(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, end_id: int = END_ID,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    rows = encoded(docs, path or public_tokenizers.path(VOCABULARY), end_id, id_col, text_col)
    order = curve_order(rows)
    totals = order.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    firsts, before = {}, 0
    for part, size in totals:
        firsts[part] = before
        before += size
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids array<long>" if with_ids else ""))
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(x, pa.list_(pa.int64()) if x == "ids" else pa.int64()) for x in names])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, part, begin, ids in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "part", "begin", "ids"))):
                ids = unpack(ids).astype("<u4")
                at, start = firsts[part] + begin, 0
                while start < len(ids):
                    size = min(length - at % length, len(ids) - start)
                    piece = ids[start : start + size]
                    out.append((doc_id, start, size, zlib.crc32(piece.tobytes()), len(ids), at // length, at % length)
                               + ((piece.tolist(),) if with_ids else ()))
                    at, start = at + size, start + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)

    placed = rows.select("row", "doc_id", "ids").join(order.select("row", "part", "begin"), "row").select("doc_id", "part", "begin", "ids")
    return in_workers(placed, cut, schema)
