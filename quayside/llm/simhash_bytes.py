"""SimHash near duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``bits`` bits share at least ``8 - bits`` of their 8 positional bytes.
Postings of single bytes would each hold a 256th of all rows, and tallies over them would be all pairs. The index
therefore posts a fingerprint under each set of ``8 - bits`` positions with the bytes there (28 sets for 2 bits): two
fingerprints meet in a posting exactly if their tally of shared bytes reaches the guaranteed minimum. A posting holds
distinct fingerprints that differ in the other bytes only, so it has at most 256 ** bits members however many
documents there are. In a posting every pair at distance 2 or less is verified through its differing bits (not by
pairing all members), and only one link per member leaves it. Exact copies are one fingerprint from the start.

Cases: a null or empty text has fingerprint zero, which links like any other; fewer words than a shingle are one
shingle; repeated rows and ids are all returned; a null id never names a component (a component of null ids only has
a null name); an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import as_bytes, in_workers, lower_words_of, map_texts
from quayside.llm.components import components
from quayside.storage import fresh_path, materialise

SHINGLE, SEED, BITS = 3, 42, 2
# Index entries one task sorts in memory.
TASK_ENTRIES = 2_000_000
_BLOCK = 1 << 16
# Postings up to this size are verified by a matrix of their members, larger ones by a bitmap of 65,536 cells.
_MATRIX = 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    words = lower_words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in shingles), "<u8", n)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[start : start + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(x) for x in as_bytes(batch.column("text"))], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(made.view(np.int64))}

    return map_texts(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make,
                     "doc_id long, fp long")


def position_sets(bits: int = BITS) -> list[tuple[int, ...]]:
    """The byte positions left out of each posting key."""
    return list(combinations(range(8), bits))


def _key_mask(left_out: tuple[int, ...]) -> int:
    return ~sum(255 << (8 * i) for i in left_out) & (2**64 - 1)


def linked(members: np.ndarray, left_out: tuple[int, ...], bits: int) -> np.ndarray:
    """Position of the first member that each member reaches by steps of ``bits`` differing bits or fewer; all
    members share the bytes that are not left out."""
    if len(members) <= _MATRIX:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= bits
        label = np.arange(len(members))
        while True:
            least = np.where(near, label[None, :], len(members)).min(axis=1)
            if (least == label).all():
                return label
            label = least
    rest = np.zeros(len(members), np.int64)
    for place, i in enumerate(left_out):
        rest |= ((members >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64) << (8 * place)
    flips = [sum(1 << i for i in chosen) for n in range(1, bits + 1) for chosen in combinations(range(8 * len(left_out)), n)]
    none = len(members)
    cells = np.full(1 << (8 * len(left_out)), none)
    cells[rest] = np.arange(none)
    while True:
        least = cells[rest]
        for flip in flips:
            np.minimum(least, cells[rest ^ flip], out=least)
        if (least == cells[rest]).all():
            return least
        cells[rest] = least


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``(a, b)``: one link per member of a posting that has a partner there. ``prints(fp)`` are distinct."""
    spark = prints.sparkSession
    sets = position_sets(bits)
    masks = [_key_mask(x) for x in sets]
    signed = [x - 2**64 if x >= 2**63 else x for x in masks]
    posted = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed])).alias("k", "key"))
    total = prints.count() * len(sets)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ENTRIES))
    entries = posted.repartition(tasks, "k", "key").select("k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column("k").to_numpy(), x.column("fp").to_numpy().view(np.uint64)) for x in batches if x.num_rows]
        if not got:
            return
        ks, fps = (np.concatenate(x) for x in zip(*got))
        left, right = [], []
        for k, mask in enumerate(masks):
            own = fps[ks == k]
            keys = own & np.uint64(mask)
            order = np.lexsort((own, keys))
            own, keys = own[order], keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(own) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(own)]
            for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                members = own[start:end]
                to = members[linked(members, sets[k], bits)]
                left.append(members[to != members])
                right.append(to[to != members])
        if left:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    return in_workers(entries, run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    spark = docs.sparkSession
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), bits), "fingerprint-links")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "fingerprint-roots")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    path = fresh_path(spark, "fingerprint-components")
    rooted.join(named, "root").select(F.col("fp").alias("node"), "component_id").write.parquet(path)
    found = spark.read.parquet(path)
    return prints.join(found, prints["fp"] == found["node"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
