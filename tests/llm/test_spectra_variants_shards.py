"""Whitening by contour integration, spelling variants by a trie frontier, shards by sampled splitters."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import splitter_shards, trie_variants
from quayside.llm.feast_whitening import above, inertia, intervals, leading_pairs, whitened_embeddings
from quayside.llm.splitter_shards import sharded
from quayside.llm.trie_variants import spelling_variants

VECTORS = "vec_id long, embedding array<float>, n long, x string, component int"


# -- whitening

def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)


def plain_whitening(rows, k=16):
    """``{(id, vector): (n, deviation, whitened, explained)}`` with numpy's eigenvectors."""
    exact = {}
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            exact[i] = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
    fit = sorted({tuple(x) for x in exact.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    matrix = centred.T @ centred / n
    values, turn = np.linalg.eigh(matrix)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ turn / np.sqrt(values),
                values / np.trace(matrix)) for i, x in exact.items()}


def compare_whitening(found, wanted, k):
    by_id = defaultdict(list)
    for row in sorted(found, key=lambda r: (r["vec_id"], r["component"])):
        by_id[row["vec_id"]].append(row)
    assert by_id.keys() == wanted.keys()
    ids = sorted(wanted)
    ours, plain = (np.array([f(i) for i in ids]) for f in (lambda i: [r["whitened"] for r in by_id[i]], lambda i: wanted[i][2]))
    assert ours.shape[1] == k and np.abs(ours * np.sign((ours * plain).sum(axis=0)) - plain).max() < 1e-9
    for i in ids:
        assert [r["component"] for r in by_id[i]] == list(range(1, k + 1))
        assert {(r["n"], r["deviation"]) for r in by_id[i]} == {wanted[i][:2]}
        assert np.allclose([r["explained"] for r in by_id[i]], wanted[i][3], rtol=1e-9)
    assert {r["identity_error"] for rows in by_id.values() for r in rows} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_whitening_of_a_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    compare_whitening(whitened_embeddings(rows).collect(), plain_whitening([tuple(x)[:2] for x in rows.select("vec_id", "embedding").collect()]), 16)


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=5) * [1, 3, 0.5, 9, 2]]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]                       # copies are fitted once
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]),
           (206, [1e30] * 5)]
    found = whitened_embeddings(vectors_of(spark, rows + odd))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert found[0]["n"] == 40
    compare_whitening(found, plain_whitening(rows), 5)
    # Repeated rows and rows without an id are returned as often as they stand there.
    again = whitened_embeddings(vectors_of(spark, [*rows, rows[1], (None, rows[2][1])])).collect()
    assert sum(r["vec_id"] == rows[1][0] for r in again) == 10 and sum(r["vec_id"] is None for r in again) == 5 and again[0]["n"] == 40
    assert whitened_embeddings(vectors_of(spark, [])).count() == 0
    assert whitened_embeddings(vectors_of(spark, odd[:5])).count() == 0
    assert whitened_embeddings(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance


def test_deviation_beyond_a_long_is_null(spark):
    found = whitened_embeddings(vectors_of(spark, [(1, [1e8]), (2, [-1e8]), (3, [0.0])])).collect()
    assert all(r["deviation"] is None for r in found if r["vec_id"] != 3) and {r["component"] for r in found} == {1}
    assert {round(abs(r["whitened"]), 6) for r in found} == {0.0, round(1.5**0.5, 6)}


def turned(values, size=None):
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(values), len(values))))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 64, 64), [5.0] * 12 + [3.0] * 12 + [1.0] * 16, 10.0 ** -np.linspace(0, 11, 30), 1 + 1e-7 * np.arange(20.0), [7.0] * 40,
    [4.0, 2.0] + [0.0] * 10, [1.0]])
def test_leading_pairs_are_those_of_a_dense_solver(values):
    matrix = turned(np.array(values))
    found, vectors = leading_pairs(matrix, 16)
    plain = np.linalg.eigvalsh(matrix)[::-1]
    assert len(found) == min(16, (np.array(values) > 1e-13 * sum(values)).sum())
    assert np.abs(found - plain[: len(found)]).max() < 1e-13 * plain[0]
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * plain[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12


def test_inertia_counts_and_intervals_cover():
    matrix = turned(np.linspace(-3, 9, 50))
    for shift in (-4.0, -0.01, 0.5, 8.9, 20.0):
        values = np.linalg.eigvalsh(matrix) - shift
        assert inertia(matrix - shift * np.eye(50)) == ((values < 0).sum(), (values > 0).sum())
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1) and inertia(np.zeros((3, 3))) == (0, 0)
    positive = turned(np.linspace(1, 50, 50))
    parts = intervals(positive, 16, 1e-9)
    assert sum(n for _, _, n in parts) >= 16 and all(b[1] == a[0] for a, b in zip(parts, parts[1:]))
    assert all(above(positive, low) - above(positive, high) == n for low, high, n in parts)


# -- variants

def plain_variants(rows):
    counts = Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
        return short[at:] == long[at + 1 :]

    ends = defaultdict(list)
    for w in words:                      # one edit leaves the first or the second half as it is
        for key in {(0, w[:3]), (1, w[-3:])}:
            ends[key].append(w)
    near = {w: {x for key in ((0, w[:3]), (1, w[-3:])) for x in ends[key] if one_edit(w, x)} for w in words}
    forms = {}
    for w, n in words.items():
        if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= 5 * n:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return sorted(out)


def found_variants(docs):
    return sorted(map(tuple, spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_of_a_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wanted = plain_variants([tuple(x) for x in docs.select("doc_id", "text").collect()])
    assert found_variants(docs) == wanted and any(x[1] for x in wanted)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(db.sql(trie_variants.ORACLE).fetchall()) == wanted


def test_variants_of_odd_words(spark, docs_of, odd_rows):
    edits = ["garden", "gardens", "gardn", "gerden", "egarden", "gardden", "aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "straße", "strasse", "strase",
             "éclair", "eclair", "éclairs", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500, "a×b÷cd", "a×b÷ce"]
    rows = [(i, " ".join([w] * (5 * 6 ** (i % 4)))) for i, w in enumerate(edits)] + odd_rows + [(1000 + i, "Garden GARDEN garden-Gardens Āgarden") for i in range(60)]
    rows += [(None, "without an id " * 300), (7, "loooong " * 40)]
    found = found_variants(docs_of(rows))
    assert found == plain_variants(rows)
    assert len(found) > 15
    assert found_variants(docs_of([])) == [] and found_variants(docs_of([(1, None), (2, "")])) == []


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("v", "w5")]
    found = dict(trie_variants.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert set(found.values()) == {"w13"} and len(found) == 14


# -- shards

def check_shards(rows, docs, shards=16, **options):
    result = sharded(docs, shards, **options)
    assert result.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = result.collect()
    assert sorted((x["doc_id"] or -1, x["size"], x["text_crc32"]) for x in found) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = Counter(), defaultdict(list)
    for x in found:
        sizes[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        assert x["law"] == "bytes" and x["grown_shard"] is None and 0 <= x["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if found:
        largest, share = max(x["size"] for x in found), sum(sizes.values()) / shards
        assert all(abs(sizes[s] - share) <= largest for s in range(shards))
    return found


def test_shards_of_a_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    found = check_shards(rows, docs)
    # Any splitters give the same shards: ranges are only the way there.
    assert sorted(map(tuple, check_shards(rows, docs, range_rows=7))) == sorted(map(tuple, found))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(db.sql(splitter_shards.ORACLE).fetchall()) == sorted(map(tuple, found))
    # Equal texts lie side by side.
    by_text = defaultdict(set)
    for x in found:
        by_text[x["text_crc32"], x["size"]].add(x["shard"])
    assert all(max(s) - min(s) == len(s) - 1 for s in by_text.values())


def test_shards_of_odd_rows(spark, docs_of, odd_rows):
    check_shards(odd_rows, docs_of(odd_rows))
    check_shards([], docs_of([]))
    check_shards([(1, "one")], docs_of([(1, "one")]))
    # A third of the rows alike in text and id: the range of their key is cut by row number.
    rows = [(5, "same text") for _ in range(200)] + [(i, "same text") for i in range(200)] + [(1000 + i, f"text {i}") for i in range(300)]
    check_shards(rows, docs_of(rows).repartition(5), range_rows=20)


def test_no_range_stays_overfull(spark, docs_of):
    rows = [(1, "hot")] * 300 + [(i, "cold " * i) for i in range(100)]
    light = splitter_shards.light_table(docs_of(rows).repartition(4), "doc_id", "text")
    size = light.agg(F.sum("size")).first()[0]
    found, counted = splitter_shards.splitters_of(light, len(rows), size, 4, 10)
    assert found == sorted(set(found)) and max(n for _, n, _ in counted) <= 10 and sum(n for _, n, _ in counted) == len(rows)
    keys = sorted(tuple(x) for x in light.select(*splitter_shards.KEY).collect())
    placed = light.select(*splitter_shards.KEY, splitter_shards.range_of(found).alias("r")).collect()
    import bisect
    assert all(r == bisect.bisect_right(found, key) for *key, r in map(tuple, placed) for key in [tuple(key)]) and len(keys) == len(rows)
