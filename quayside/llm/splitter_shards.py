"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by a key: a number made of their text, then the id, then a row number that is written once. Equal
texts are therefore neighbours, and no key is so frequent that a range of it could not be cut. Splitters are quantiles of a
sample in which a row is drawn in proportion to its size; they cut the key space into many more ranges than there are
shards. Ranges are counted, and those with too many rows are subdivided by splitters from a sample of their own, until
none is overfull. Sizes within a range are summed in key order, and the range that holds the end of a shard is cut there,
between two rows. A shard differs from its share by less than the largest row.

Everything but the light table of keys and sizes is made of DataFrame expressions over that table; texts are read once
and never shuffled. The driver sees sampled keys and one row per range (at most about SAMPLES_PER_RANGE times and twice
the number of ranges, which is bounded by MOST_RANGES).

Cases: a null text is an empty one and has size 1; equal texts are ordered by id (null first); repeated rows have slots
of their own; a text of any length is one row; fewer rows than shards leave shards empty; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.storage import materialise

SHARDS = 16
# A range of more rows is overfull, unless that would make more than MOST_RANGES of them.
RANGE_ROWS, MOST_RANGES = 1 << 20, 1 << 14
# Ranges per shard at least, and sampled keys per range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 8, 16
KEY = ("text_key", "id_key", "row")
_FIRST_ID = -(1 << 63)


def light_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, size, text_crc32`` and the key of every row, written once; row numbers are fixed by the write."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    return materialise(rows.select(
        "doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        # Sixty bits of the digest: a number that other engines make alike.
        F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long").alias("text_key"),
        F.coalesce("doc_id", F.lit(_FIRST_ID)).alias("id_key"),
        F.monotonically_increasing_id().alias("row")), "shard-keys")


def fixed_array(values: list, kind: str) -> Column:
    """A driver list as one folded literal."""
    return F.from_json(F.lit(json.dumps(values)), F.lit(f"array<{kind}>"))


def range_of(splitters: list[tuple[int, ...]]) -> Column:
    """Number of splitters up to the key of a row, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    listed = fixed_array([dict(zip(KEY, x)) for x in splitters], "struct<text_key:bigint,id_key:bigint,row:bigint>")
    key, n = F.struct(*KEY), len(splitters)
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.get(listed, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at))


def sampled(rows: DataFrame, share: Column, weight: Column, seed: int) -> list[tuple[tuple[int, ...], float]]:
    """Keys drawn with probability ``share``, in order, with their weights. The draw depends on the row number alone."""
    chance = F.shiftrightunsigned(F.xxhash64("row", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = rows.where(chance < share).select(*KEY, weight.cast("double").alias("weight")).collect()
    return sorted((tuple(x)[:3], x["weight"]) for x in drawn)


def quantiles(sample: list[tuple[tuple[int, ...], float]], parts: int) -> list[tuple[int, ...]]:
    """The keys at which the sample's weight passes each ``parts``-th of the whole."""
    step = sum(w for _, w in sample) / parts if sample else 1.0
    cuts, passed = [], 0.0
    for key, weight in sample:
        if int(passed / step) < int((passed + weight) / step) and passed:
            cuts.append(key)
        passed += weight
    return cuts


def splitters_of(light: DataFrame, rows: int, size: int, shards: int, range_rows: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Splitters without overfull ranges, and ``range, rows, size`` of every range that holds rows."""
    most = max(range_rows, rows // MOST_RANGES)
    ranges = max(shards * RANGES_PER_SHARD, math.ceil(2 * rows / most))
    wanted = ranges * SAMPLES_PER_RANGE
    # One in size/wanted bytes is drawn; a row larger than that is always drawn and counts with its own size.
    found = quantiles(sampled(light, F.col("size") * F.lit(wanted / size), F.greatest(F.col("size"), F.lit(size / wanted)), 1), ranges)
    seed = 1
    while True:
        ranged = light.withColumn("range", range_of(found))
        counted = sorted(tuple(x) for x in ranged.groupBy("range").agg(F.count(F.lit(1)), F.sum("size")).collect())
        overfull = {r: math.ceil(2 * n / most) for r, n, _ in counted if n > most}
        if not overfull:
            return found, counted
        seed += 1
        shares = [0.0] * (len(found) + 1)
        for r, n, _ in counted:
            if r in overfull:
                shares[r] = min(1.0, overfull[r] * SAMPLES_PER_RANGE / n)
        drawn = sampled(ranged, F.get(fixed_array(shares, "double"), F.col("range")), F.col("range"), seed)
        more: dict[float, list] = {}
        for key, r in drawn:
            more.setdefault(r, []).append((key, 1.0))
        found = sorted({*found, *(cut for r, sample in more.items() for cut in quantiles(sample, overfull[int(r)]))})


def sharded(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text",
            range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``."""
    light = light_table(docs, id_col, text_col)
    rows, size = light.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    found, counted = splitters_of(light, rows, size, shards, range_rows) if rows else ([], [])
    sizes_before, rows_before = [0] * (len(found) + 1), [0] * (len(found) + 1)
    passed_rows = passed_size = 0
    for r, n, s in counted:
        rows_before[r], sizes_before[r] = passed_rows, passed_size
        passed_rows, passed_size = passed_rows + n, passed_size + s
    within = Window.partitionBy("range").orderBy(*KEY)
    run = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = light.withColumn("range", range_of(found)).select(
        "doc_id", "size", "text_crc32",
        (F.get(fixed_array(rows_before, "bigint"), F.col("range")) + F.row_number().over(within) - 1).alias("place"),
        (F.get(fixed_array(sizes_before, "bigint"), F.col("range")) + F.sum("size").over(run)).alias("end"))
    # The shard that holds the middle byte of the row.
    shard = F.expr(f"least({shards - 1}, (2 * end - size) * {shards} div {2 * max(size, 1)})").cast("int")
    placed = materialise(placed.withColumn("shard", shard).drop("end"), "shard-places")
    starts = dict(placed.groupBy("shard").agg(F.min("place")).collect())
    first = fixed_array([starts.get(i, 0) for i in range(shards)], "bigint")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("place") - F.get(first, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
codes AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
rows_of AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
keyed AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS k, text FROM rows_of),
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT text FROM rows_of), codes),
summed AS (
  SELECT doc_id, size, text, k, sum(size) OVER () AS total,
    sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS passed FROM keyed),
cut AS (SELECT *, least(15, CAST((2 * passed - size) * 16 // (2 * total) AS INTEGER)) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut JOIN crcs USING (text)
"""
