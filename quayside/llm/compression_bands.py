"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses too well, random text hardly at all. Both ends are cut by limits that depend on the
length, because a short text compresses badly whatever it says.

Cases: a null or empty text has no words, ratio 1 and fails the base rules; a text shorter than a chunk has one
chunk; repeated rows are judged alike; null ids are carried through; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quayside.llm.common import as_bytes, filter_texts, map_texts

# (UTF-8 bytes from, lowest ratio, highest ratio) of compressed to raw size.
BANDS = (
    (0, 0.0, 9.0),
    (200, 0.30, 1.10),
    (400, 0.30, 0.95),
    (1600, 0.28, 0.80),
    (6400, 0.25, 0.72),
    (25600, 0.22, 0.70),
)
CHUNK_BYTES = 2048
CHUNK_LOW, CHUNK_HIGH = 0.28, 0.78
# More than this share of chunks outside their band rejects a document.
CHUNK_SHARE = 0.34
LEVEL = 3
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, n_bytes long, ratio double, n_chunks long, chunks_low long, chunks_high long, "
          "verdict string, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = covered = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)``."""
    words = text.split()
    points = len(text.decode("utf-8", "replace")) - sum(text.count(x) for x in _SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points, sum(text.count(x) for x in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def band_of(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return bands[bisect_right([x[0] for x in bands], n_bytes) - 1][1:]


def judge(text: bytes, compress, bands=BANDS, chunk: int = CHUNK_BYTES) -> tuple[float, int, int, int, str]:
    """``(ratio, chunks, chunks below, chunks above, verdict)``; the last chunk takes the rest of the text."""
    if not text:
        return 1.0, 0, 0, 0, "empty"
    ratio = len(compress(text)) / len(text)
    starts = range(0, max(1, len(text) // chunk) * chunk, chunk)
    low = high = 0
    if len(starts) > 1:
        for i, start in enumerate(starts):
            piece = text[start:] if i + 1 == len(starts) else text[start : start + chunk]
            share = len(compress(piece)) / len(piece)
            low += share < CHUNK_LOW
            high += share > CHUNK_HIGH
    least, most = band_of(len(text), bands)
    verdict = ("repetitive" if ratio < least else "incompressible" if ratio > most else
               "repetitive chunks" if low > CHUNK_SHARE * len(starts) else
               "incompressible chunks" if high > CHUNK_SHARE * len(starts) else "pass")
    return ratio, len(starts), low, high, verdict


def verdicts(texts: list[bytes], bands=BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> list[tuple]:
    """The columns of SCHEMA after the id, a row per text."""
    compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
    rows = []
    for text in texts:
        base = base_counts(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        verdict = judge(text, compress, bands, chunk_bytes)
        rows.append((*base, failed, len(text), *verdict, not failed and verdict[4] == "pass"))
    return rows


def compression_bands(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: the base counts, its ratios and whether it is kept. One pass, no shuffle."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def make(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id")} | dict(zip(names[1:], zip(*verdicts(as_bytes(batch.column("text")), **limits))))

    return map_texts(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, SCHEMA)


def within_bands(docs: DataFrame, *, text_col: str = "text", **limits) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return filter_texts(docs, lambda texts: [x[-1] for x in verdicts(texts, **limits)], text_col)
