"""Quality classifier: cumulative-link ordinal regression over hashed text.

Ratings are grades 0 < 1 < ... < K-1. All cuts share one weight vector over hashed features (words, word ends, word
shapes, a few facts of the whole text); ordered thresholds turn the one value into ``P(grade > k)``. From these come
the expected grade and the tail probability by which documents are selected.

Cases: a null or empty text has no words and only whole-text features; a document with several ratings has the
lowest; ratings without grade or id are ignored; with fewer than two grades among the ratings the tail probability is
their share for every document (1 if there are none); repeated rows and null ids are judged alike; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Memo, as_bytes, filter_texts, fold, map_texts
from quayside.storage import materialise

BUCKETS = 1 << 16
# Documented bound of the training sample.
TRAIN_DOCS = 8192
FOLDS, HELD_FOLD = 5, 0
SELECT = 0.5
SCALE = 12.0
MEMO_WORDS = 300_000


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh64_intdigest(kind + value, 7) % BUCKETS


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word: its lower-case letters, its end, its shape."""
    shape = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in word)
    short = bytes(b for i, b in enumerate(shape) if i == 0 or shape[i - 1] != b)
    return _bucket(b"w", word.lower()), _bucket(b"e", word[-3:]), _bucket(b"s", short[:12])


def text_features(text: bytes, words: list[bytes], distinct: int) -> tuple[int, ...]:
    """Buckets of facts of the whole text: size, share of distinct words, share of upper case and of symbols."""
    size = len(words)
    tenth = lambda x: b"%d" % int(10 * x)
    letters = max(1, len(text))
    upper = sum(text.count(b"%c" % c) for c in range(65, 91)) / letters
    symbols = sum(text.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"!", b"<", b">")) / letters
    log_size = size.bit_length()
    return (_bucket(b"n", b"%d" % log_size), _bucket(b"d", b"%d " % log_size + tenth(distinct / max(1, size))),
            _bucket(b"u", tenth(upper)), _bucket(b"y", b"%d" % int(30 * symbols)))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and values: words by their share of the text, whole-text facts as one each."""
    words = text.split()
    counts = Counter(words)
    total: Counter = Counter()
    for word, n in counts.items():
        for at in word_features(word):
            total[at] += SCALE * n / len(words)
    for at in text_features(text, words, len(counts)):
        total[at] += 1.0
    return np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.float64, len(total))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def value(self, text: bytes, word_value) -> float:
        words = text.split()
        whole = text_features(text, words, len(set(words)))
        return (SCALE * sum(map(word_value, words)) / len(words) if words else 0.0) + float(self.weights[list(whole)].sum())

    def tails(self, value: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` per row and cut."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds[None, :], -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int, rounds: int = 250,
          rate: float = 0.05, ridge: float = 2e-4) -> Model:
    """Maximum likelihood of all cuts, by Adam over all rows. Thresholds are a first one and positive steps.

    Grades weigh alike: rare ones are not drowned by common ones.
    """
    where = np.concatenate([x for x, _ in rows])
    what = np.concatenate([x for _, x in rows])
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    weight = (1 / np.maximum(np.bincount(grade, minlength=grades), 1))[grade] / grades
    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    v = np.zeros(BUCKETS + grades - 1)
    first, second = np.zeros_like(v), np.zeros_like(v)
    for i in range(1, rounds + 1):
        steps = np.exp(v[BUCKETS + 1 :])
        cuts = v[BUCKETS] + np.r_[0.0, np.cumsum(steps)]
        value = np.bincount(owner, what * v[where], minlength=len(rows))
        # cumulative logit: each cut is a logistic regression on the shared value
        error = (1 / (1 + np.exp(-np.clip(value[:, None] - cuts, -40, 40))) - above) * weight[:, None]
        slope = np.r_[np.bincount(where, what * error.sum(axis=1)[owner], minlength=BUCKETS) + ridge * v[:BUCKETS],
                      -error.sum(), -(error.sum(axis=0)[::-1].cumsum()[::-1][1:]) * steps]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        v = v - rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-9)
    return Model(v[:BUCKETS].astype(np.float32), v[BUCKETS] + np.r_[0.0, np.cumsum(np.exp(v[BUCKETS + 1 :]))])


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3) -> tuple[Model | None, np.ndarray]:
    """The model (None with fewer than two grades) and the share of ratings above each cut.

    ``ratings(doc_id, grade)``. At most TRAIN_DOCS rated documents, by hash order, reach the driver, as hashed
    features; the held-out fold never does.
    """
    rated = ratings.where("doc_id is not null and grade is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_FOLD).groupBy(
        F.col("doc_id").cast("long").alias("rated")).agg(F.min(F.col("grade").cast("int")).alias("grade"))
    chosen = F.broadcast(rated.orderBy(F.xxhash64("rated"), "rated").limit(TRAIN_DOCS))  # bounded by TRAIN_DOCS
    sample = docs.join(chosen, docs["doc_id"].cast("long") == chosen["rated"]).select("text", "grade")

    def make(batch: pa.RecordBatch) -> dict:
        made = [features(x) for x in as_bytes(batch.column("text"))]
        return {"grade": batch.column("grade"), "at": [x for x, _ in made], "x": [x for _, x in made]}

    table = materialise(map_texts(sample, make, "grade int, at array<int>, x array<float>"), "quality-features").toArrow()
    grade = np.clip(table["grade"].to_numpy(), 0, grades - 1)
    if len(set(grade.tolist())) < 2:
        return None, np.array([(grade > k).mean() if len(grade) else 1.0 for k in range(grades - 1)])
    cut = lambda name: [np.asarray(x, t) for t, x in ((np.int64 if name == "at" else np.float64, y.values.to_numpy()) for y in table[name])]
    rows = list(zip(cut("at"), cut("x")))
    return train(rows, grade, grades), np.empty(0)


_memo: dict = {}


def scorer(docs: DataFrame, ratings: DataFrame, grades: int = 3):
    """A function from texts to ``P(grade > k)``, a row per text and a column per cut, for use in tasks."""
    model, shares = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratings, grades)
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def tails(texts: list[bytes]) -> np.ndarray:
        own = shared.value
        if own is None:
            return np.repeat(shares[None, :], len(texts), axis=0)
        if token not in _memo:
            _memo.clear()
            weights = own.weights
            _memo[token] = Memo(lambda w: float(weights[list(word_features(w))].sum()), MEMO_WORDS)
        return own.tails(np.array([own.value(x, _memo[token].__getitem__) for x in texts]))

    return tails


def ordinal_quality(docs: DataFrame, ratings: DataFrame, *, grades: int = 3, least_grade: int = 1, select: float = SELECT) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` of every document: the tail is ``P(grade >= least_grade)``,
    and documents with a tail of ``select`` or more are kept."""
    tails = scorer(docs, ratings, grades)

    def make(batch: pa.RecordBatch) -> dict:
        found = tails(as_bytes(batch.column("text")))
        tail = found[:, least_grade - 1]
        return {"doc_id": batch.column("doc_id"), "expected_grade": found.sum(axis=1), "tail_probability": tail, "kept": tail >= select}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                     "doc_id long, expected_grade double, tail_probability double, kept boolean")


def of_quality(docs: DataFrame, ratings: DataFrame, *, grades: int = 3, least_grade: int = 1, select: float = SELECT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    tails = scorer(docs, ratings, grades)
    return filter_texts(docs, lambda texts: (tails(texts)[:, least_grade - 1] >= select).tolist())


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 junk, 1 sound but toxic, 2 sound."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
