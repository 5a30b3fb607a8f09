"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

Two strings are alike by the subsequences of three characters they share, gaps allowed: an occurrence weighs
``DECAY ** gaps`` (Lodhi et al. 2002), the ends of a string count as characters, and the kernel is normed by the
weights of all occurrences and raised to the third power. Gapped, stretched and inflected insults stay close to their landmark; punctuation inside a string is
taken out, and runs of single letters are read as one string as well.

Training: labelled sentences (each distinct one once) of a bounded sample of labelled documents give, per string, the
toxic and clean sentences that hold it. Strings that are significantly toxic, themselves or by their stem, are
positive examples and, with frequent
and confusable clean strings, landmarks; the SVM is fitted in the Nyström space, negatives are mined once more over
all strings of the sample, and a logistic curve over a document's two best strings gives the score.

Cases: a null or empty text and a text without strings have the score of no evidence; strings above LONGEST are read
in overlapping windows, so any length is covered; without toxic labels every score is zero; several labels of a
document count as toxic if one is; repeated rows and null ids are scored like any other; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import as_bytes, calls, fold, in_workers, map_texts
from quayside.storage import materialise

DECAY, BUCKET_BITS, LONGEST = 0.6, 15, 20
FOLDS, HELD_FOLD, THRESHOLD = 3, 1, 0.7
# Documented bounds of the training sample: labelled documents of each kind, strings, landmarks.
TOXIC_DOCS, CLEAN_DOCS = 4096, 8192
POSITIVES, NEGATIVES = 2000, 15000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 112, 16
SIGNIFICANT, LIFT = 30.0, 2.5
STEMS = (4, 5, 6)
MEMO_STRINGS = 300_000
# Strings compared with each other at a time when landmarks are chosen; numbers that are gathered at a time.
VARIED_PART, CELLS = 1000, 1 << 17
# Text of which the strings are held at once.
PART_BYTES = 1 << 20
NOTHING = -2.0
_SENTENCE = re.compile(r"[.!?\n]+")
_INSIDE = re.compile(r"[\W_]+")


def strings_of(words: list[str]) -> list[str]:
    """Comparable strings of lower-case words: punctuation taken out, runs of three or more single letters joined."""
    plain = [x if x.isalnum() else _INSIDE.sub("", x) for x in words]
    joined = []
    if sum(len(x) == 1 for x in plain) > 2:
        joined = [s for single, run in groupby(plain, lambda x: len(x) == 1) if single and len(s := "".join(run)) > 2]
    return [x for x in plain if x] + joined


@cache
def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three characters, and their normed weights."""
    places = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
    weights = DECAY ** (places[:, 2] - places[:, 0] - 2.0)
    return places, (weights / np.sqrt((weights * weights).sum())).astype(np.float32)


def buckets(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subsequences of strings of one length, and their weights."""
    codes = np.array([[2, *map(ord, x), 3] for x in strings], np.uint64)
    places, weights = triples(codes.shape[1])
    a, b, c = (codes[:, places[:, i]] for i in range(3))
    mixed = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77C2B2AE63) + c * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), weights


def windows(text: str) -> list[str]:
    if len(text) <= LONGEST:
        return [text]
    return [text[i : i + LONGEST] for i in range(0, len(text) - LONGEST // 2, LONGEST // 2)]


@dataclass
class Landmarks:
    """Strings to compare with: ``rows`` has a line per bucket that one of them holds, ``row_of`` the line of each bucket.

    Line 0 is empty: it stands for all buckets that no landmark holds, so what is looked up again and again stays small.
    """

    row_of: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(strings: list[str]) -> Landmarks:
        at = [buckets([x]) for x in strings]
        held = np.unique(np.concatenate([x[0].ravel() for x in at]))
        row_of = np.zeros(1 << BUCKET_BITS, np.int32)
        row_of[held] = np.arange(1, len(held) + 1)
        rows = np.zeros((len(held) + 1, len(strings)), np.float32)
        for column, (places, weights) in enumerate(at):
            np.add.at(rows[:, column], row_of[places[0]], weights)
        return Landmarks(row_of, rows)


def kernel(strings: list[str], landmarks: Landmarks) -> np.ndarray:
    """Kernel of strings (at most LONGEST characters) with each landmark."""
    many = landmarks.rows.shape[1]
    out = np.empty((len(strings), many), np.float32)
    by_length = defaultdict(list)
    for i, x in enumerate(strings):
        by_length[len(x)].append(i)
    for length, own in by_length.items():
        size = len(triples(length + 2)[0])
        step = max(1, CELLS // (size * many))
        for start in range(0, len(own), 64 * step):
            some = own[start : start + 64 * step]
            at, weights = buckets([strings[i] for i in some])
            at = landmarks.row_of[at]
            for i in range(0, len(some), step):
                lines = landmarks.rows.take(at[i : i + step].T.ravel(), axis=0)
                out[some[i : i + step]] = (weights @ lines.reshape(size, -1)).reshape(-1, many)
    np.maximum(out, 0, out=out)
    return out * out * out


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def strings(self, strings: list[str]) -> np.ndarray:
        """SVM value of each string; a long one has that of its best window."""
        pieces = [windows(x) for x in strings]
        values = kernel([y for x in pieces for y in x], self.landmarks) @ self.weights + self.bias
        if len(values) == len(strings):
            return values
        return np.maximum.reduceat(values, np.cumsum([0] + [len(x) for x in pieces[:-1]]))

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(best @ np.array(self.curve[:2]) + self.curve[2], -50, 50)))


def varied(strings: list[str], most: int, apart: float = 0.5) -> list[str]:
    """The first strings (windows of long ones) that are not too alike to an earlier choice, out of all of them."""
    listed = [*dict.fromkeys(y for x in strings for y in windows(x))]
    chosen: list[str] = []
    # A part at a time: what is like an earlier choice, then what is like another one of the part.
    for start in range(0, len(listed), VARIED_PART):
        part = listed[start : start + VARIED_PART]
        if chosen:
            part = [x for x, near in zip(part, kernel(part, Landmarks.of(chosen)).max(axis=1)) if near < apart]
        alike, own = kernel(part, Landmarks.of(part)) if part else None, []
        for i in range(len(part)):
            if len(chosen) + len(own) < most and (not own or alike[i, own].max() < apart):
                own.append(i)
        chosen += [part[i] for i in own]
        if len(chosen) >= most:
            break
    return chosen


def svm(features: np.ndarray, sign: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Adam over all rows."""
    data = np.c_[features, np.ones(len(features))]
    v, first, second = (np.zeros(data.shape[1]) for _ in range(3))
    v[-1] = -1.0
    total = weight.sum()
    for i in range(1, rounds + 1):
        pull = np.maximum(1 - sign * (data @ v), 0) * weight * sign
        slope = -2 * (data.T @ pull) / total
        slope[:-1] += ridge * v[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        v = v - 0.1 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return v[:-1], float(v[-1])


def fit_strings(positive: list[tuple[str, float]], negative: list[tuple[str, float]], hard: list[str]) -> Model:
    """SVM over strings with weights, in the Nyström space of landmarks taken from both kinds."""
    landmarks = [*dict.fromkeys(
        varied([x for x, _ in positive], TOXIC_LANDMARKS) + varied(hard, CLEAN_LANDMARKS // 2)
        + varied([x for x, _ in negative], CLEAN_LANDMARKS // 2 if hard else CLEAN_LANDMARKS))]
    known = Landmarks.of(landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks, known).astype(float) + 1e-3 * np.eye(len(landmarks)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    # Long strings are learnt as they are scored: by their windows, which share the weight of a positive one.
    rows = [(y, w / len(pieces), 1.0) for x, w in positive for pieces in [windows(x)] for y in pieces]
    rows += [(y, w, -1.0) for x, w in [*negative, *((x, 1.0) for x in hard)] for y in windows(x)]
    sign = np.array([x[2] for x in rows])
    weight = np.sqrt(np.maximum([x[1] for x in rows], 1.0))
    weight[sign > 0] *= 0.5 * weight[sign < 0].sum() / weight[sign > 0].sum()
    v, bias = svm(kernel([x[0] for x in rows], known) @ root, sign, weight)
    return Model(known, (root @ v).astype(np.float32), bias)


def logistic(best: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Newton's method with a small ridge; keeps finite on separable data."""
    data, w = np.c_[best, np.ones(len(best))], np.zeros(3)
    ridge = np.diag([0.05, 0.05, 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        slope = data.T @ (p - label) + ridge @ w
        w = w - np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + ridge, slope)
    return tuple(w.tolist())


_memo: dict = {}


def best_two(texts: list[bytes], model: Model, memo: dict) -> np.ndarray:
    """The two largest string values of each text."""
    own = [strings_of(x.decode("utf-8", "replace").lower().split()) for x in texts]
    new = {y for x in own for y in x if y not in memo}
    if len(memo) + len(new) > MEMO_STRINGS:
        memo.clear()
        new = {y for x in own for y in x}
    if new:
        listed = list(new)
        memo.update(zip(listed, model.strings(listed).tolist()))
    out = np.full((len(texts), 2), NOTHING)
    for i, x in enumerate(own):
        if x:
            values = sorted(map(memo.__getitem__, x))
            out[i, 0] = values[-1]
            out[i, 1] = values[-2] if len(values) > 1 else NOTHING
    return np.maximum(out, NOTHING)


def units(sentence: str) -> set[str]:
    """What is counted of a sentence: its strings, their stems (marked by a star), and the sentence itself."""
    strings = set(strings_of(sentence.split()))
    return strings | {x[:n] + "*" for n in STEMS for x in strings if len(x) > n} | {""}


def training_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic``: the bounded sample, by hash order, without the held-out fold."""
    marked = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_FOLD).groupBy(
        F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    by_hash = [F.xxhash64("labelled"), F.col("labelled")]
    chosen = marked.where("toxic = 1").orderBy(*by_hash).limit(TOXIC_DOCS).unionByName(
        marked.where("toxic = 0").orderBy(*by_hash).limit(CLEAN_DOCS))
    chosen = F.broadcast(chosen)  # at most TOXIC_DOCS + CLEAN_DOCS rows of two numbers
    rows = docs.join(chosen, docs["doc_id"].cast("long") == chosen["labelled"])
    return materialise(rows.select(docs["doc_id"], docs["text"], "toxic"), "toxicity-sample")


def sentence_counts(sample: DataFrame) -> DataFrame:
    """``string, toxic, n``: distinct sentences of each kind that hold the string; the empty string counts them all."""
    def split(batch: pa.RecordBatch) -> dict:
        rows = [(s.strip(), t) for text, t in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist())
                for s in _SENTENCE.split(text.decode("utf-8", "replace").lower()) if s.strip()]
        return {"sentence": [x for x, _ in rows], "toxic": [t for _, t in rows]}

    sentences = map_texts(sample, split, "sentence string, toxic int").groupBy("sentence").agg(F.max("toxic").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in calls(batch, "sentence"):
                seen: Counter = Counter()
                for text, t in zip(cut.column("sentence").to_pylist(), cut.column("toxic").to_pylist()):
                    seen.update((x, t) for x in units(text))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()),
                                                  pa.array(list(seen.values()), pa.int64())], ["string", "toxic", "n"])

    counted = in_workers(sentences, count, "string string, toxic int, n long")
    return materialise(counted.groupBy("string").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0")), "toxicity-strings")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None if nothing is significantly toxic in the sample."""
    sample = training_docs(docs, labels)
    counts = sentence_counts(sample)
    total = counts.where("string = ''").first()
    if not total or not total["n1"] or not total["n0"]:
        return None
    t1, t0 = float(total["n1"]), float(total["n0"])
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    part = lambda k, of, q: F.when(k > 0, k * F.log(k / of / q)).otherwise(0.0)
    rate = (n1 + n0) / (t1 + t0)
    ratio = 2 * (part(n1, t1, rate) + part(n0, t0, rate) + part(t1 - n1, t1, 1 - rate) + part(t0 - n0, t0, 1 - rate))
    lift = F.log((n1 + 0.5) / (t1 + 1)) - F.log((n0 + 0.5) / (t0 + 1))
    scored = counts.where("string <> ''").select("string", "n1", "n0", ratio.alias("ratio"), lift.alias("lift"))
    toxic = (F.col("ratio") > SIGNIFICANT) & (F.col("lift") > LIFT)
    # A stem can be significant where none of its many inflected forms is.
    of_stem = scored.where(toxic & F.col("string").endswith("*")).orderBy(F.desc("ratio"), "string").limit(POSITIVES)
    stems = [x["string"] for x in of_stem.collect()]
    words = scored.where(~F.col("string").endswith("*"))
    inflected = F.lit(False)
    for n in STEMS:
        inflected = inflected | F.concat(F.substring("string", 1, n), F.lit("*")).isin(stems)
    chosen = toxic | inflected & (F.col("n1") > 0) & (F.col("n0") == 0)
    positive = [(x["string"], x["n1"]) for x in words.where(chosen).orderBy(F.desc("ratio"), "string").limit(POSITIVES).collect()]
    if not positive:
        return None
    clean = words.where((F.col("ratio") <= SIGNIFICANT / 3) | (F.col("lift") <= 0.5)).where(~inflected & (F.col("n0") > 0))
    negative = [(x["string"], x["n0"]) for x in clean.orderBy(F.desc("n0"), "string").limit(NEGATIVES).collect()]
    rare = [(x["string"], x["n0"]) for x in clean.orderBy(F.xxhash64("string"), "string").limit(NEGATIVES).collect()]
    negative = list(dict([*negative, *rare]).items())
    shared = docs.sparkSession.sparkContext.broadcast(fit_strings(positive, negative, []))

    def confuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column("string").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("string"), pa.array(shared.value.strings(strings).astype(float) if strings else [], pa.float64())],
                                             ["string", "value"])

    hard = in_workers(clean.select("string"), confuse, "string string, value double").orderBy(F.desc("value"), "string").limit(NEGATIVES)
    model = fit_strings(positive, negative, [x["string"] for x in hard.collect()])
    values = map_best(sample.select("doc_id", "text", "toxic"), model, ["toxic"]).toPandas()
    model.curve = logistic(values[["best", "next"]].to_numpy(float), values["toxic"].to_numpy(float))
    return model


def map_best(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``best, next`` of every text, beside the columns of ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex
    fields = ", ".join(f"{x} {dict(docs.dtypes)[x]}" for x in keep)

    def make(batch: pa.RecordBatch) -> dict:
        if token not in _memo:
            _memo.clear()
            _memo[token] = {}
        texts = as_bytes(batch.column("text"))
        edges = np.flatnonzero(np.diff(np.cumsum([len(x) for x in texts]) // PART_BYTES)) + 1
        parts = [texts[a:b] for a, b in zip([0, *edges], [*edges, len(texts)])]
        best = np.concatenate([best_two(x, shared.value, _memo[token]) for x in parts])
        return {x: batch.column(x) for x in keep} | {"best": best[:, 0], "next": best[:, 1]}

    return map_texts(docs, make, f"{fields}, best double, next double")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    a, b, c = model.curve
    score = 1 / (1 + F.exp(-(F.lit(a) * F.col("best") + F.lit(b) * F.col("next") + F.lit(c))))
    found = map_best(docs, model, ["doc_id"])
    return found.select("doc_id", held, score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
