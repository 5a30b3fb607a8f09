"""Katz scores against a plain Python model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from quayside.llm import katz
from quayside.llm.katz import CUTOFF, katz_scores

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows):
    """Scores of ``(doc_id, text)`` and the conditional probability function."""
    train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    uni, bi, follow = Counter(), Counter(), {}
    for words in train:
        uni.update(words)
        for h, w in zip(["<s>", *words], words):
            bi[h, w] += 1
    history = Counter()
    for (h, w), c in bi.items():
        history[h] += c
        follow.setdefault(h, []).append(w)
    total, size = sum(uni.values()), len(uni)

    def factors(counts):
        n = Counter(counts)
        most, d = total / (total + 1), {}
        tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
        for r in range(1, CUTOFF + 1):
            x = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) if n[r] and tail != 1 else -1
            d[r] = min(x if 0 < x < 1 else (r - 0.5) / r, most)
        return lambda c: d.get(c, most)

    d1, d2 = factors(uni.values()), factors(bi.values())
    unknown = 1 - sum(d1(c) * c / total for c in uni.values()) if total else 1.0
    single = lambda w: d1(uni[w]) * uni[w] / total if uni[w] else unknown

    def alpha(h):
        seen = follow[h]
        return (1 - sum(d2(bi[h, w]) * bi[h, w] / history[h] for w in seen)) / (1 - sum(map(single, seen)))

    def probability(w, h):
        if h not in follow:
            return single(w)
        return d2(bi[h, w]) * bi[h, w] / history[h] if bi[h, w] else alpha(h) * single(w)

    out = []
    for i, text in rows:
        words = tokens(text)
        out.append((i, len(words), sum(uni[w] > 0 for w in words), total,
                    sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (size + 1))) for w in words),
                    sum(math.log10(probability(w, h)) for h, w in zip(["<s>", *words], words))))
    return out, probability, uni, follow


def compare(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, score="x") for i, t in rows], SCHEMA)
    found = sorted((tuple(x) for x in katz_scores(docs).collect()), key=repr)
    wanted = brute(rows)[0]
    assert len(found) == len(wanted)
    key = lambda x: (repr(x[0]), round(x[-1], 6))
    for a, b in zip(sorted(((i, n, k, t, base, s) for i, _, n, k, t, base, s in found), key=key), sorted(wanted, key=key)):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], abs=1e-6)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 200)


def corpus(size=150, seed=3):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(size):
        n = int(rng.integers(0, 40))
        rows.append((i, " ".join(names[min(59, int(x))] for x in rng.geometric(0.12, n))))
    return rows


def test_scores_equal_a_plain_model(spark, small_blocks):
    compare(spark, corpus())


def test_hot_history_nulls_copies_and_long_texts(spark, small_blocks):
    rows = corpus(60) + [(1000 + i, "hot pair " * 60) for i in range(30)]
    rows += [(5, "A\tb\nA B"), (5, "A\tb\nA B"), (None, "w1 w2 only_here"), (7, None), (8, ""), (9, "x" * 5000 + " " + "y z " * 3000)]
    compare(spark, rows)


def test_untrained_and_empty(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    compare(spark, [(i, "a b a") for i in held])
    assert katz_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probabilities_sum_to_one():
    _, probability, uni, follow = brute(corpus(80))
    for h in [*follow, "never seen"]:
        assert sum(probability(w, h) for w in [*uni, "unknown"]) == pytest.approx(1.0, abs=1e-9)
