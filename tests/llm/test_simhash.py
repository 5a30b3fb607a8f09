"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import regex
import xxhash

from quayside.llm import simhash_bytes
from quayside.llm.components import components
from quayside.llm.simhash_bytes import fingerprint, linked, near_duplicates, position_sets

SMALL = "/root/testdata/sf0.001"


def brute_print(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, bits=2):
    """Component of each (id, fingerprint): the smallest id reachable."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in prints]


def check(df, rows):
    wanted = brute_components([(i, brute_print(t)) for i, t in rows])
    assert sorted(map(tuple, near_duplicates(df).collect()), key=repr) == sorted(wanted, key=repr)


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(df, [(x.doc_id, x.text) for x in df.collect()])


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    check(docs_of(odd_rows), odd_rows)
    assert near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("matrix", [0, 10_000])
def test_postings_link_exactly_the_near_members(monkeypatch, matrix):
    monkeypatch.setattr(simhash_bytes, "_MATRIX", matrix)
    rng = np.random.default_rng(1)
    for left_out in position_sets():
        values = rng.choice(1 << 16, 300, replace=False)
        members = np.array([sum(int(v >> (8 * j) & 255) << (8 * p) for j, p in enumerate(left_out)) for v in values], np.uint64)
        found = linked(members, left_out, 2)
        wanted = brute_components([(i, int(m)) for i, m in enumerate(members)])
        same = lambda labels: [labels.index(x) for x in labels]
        assert same(found.tolist()) == same([x[2] for x in wanted])


def test_chains_and_large_groups(spark, monkeypatch):
    """A long chain of small steps, and fingerprints that all share most bytes."""
    rng = np.random.default_rng(2)
    chain, at = [], 0x0123456789ABCDEF
    for _ in range(60):
        at ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
        chain.append(at)
    cluster = [0xFFFF0000FFFF0000 ^ int(x) for x in rng.choice(1 << 16, 2000, replace=False)]
    prints = list(enumerate(chain + cluster + [int(x) for x in rng.integers(0, 2**63, 300)], 100))
    frame = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in prints], "doc_id long, fp long")
    monkeypatch.setattr(simhash_bytes, "fingerprints", lambda docs, *_: frame)
    found = sorted(map(tuple, near_duplicates(frame).collect()))
    assert found == sorted(brute_components(prints))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(101)} | {500 + i: 500 for i in range(50)}
    assert fingerprint(b"") == 0
