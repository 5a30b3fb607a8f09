"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words. Passages and benchmark items become TF-IDF vectors; a randomised
SVD (subspace iteration on the sums of products of the passage matrix, which Spark tasks make and multiply) gives a latent
basis, and passages and items are projected to it and compared there: a passage is a candidate for an item if the cosine between the
whole passage and the item's latent direction reaches a threshold. Words that occur together share directions, so a passage
is near an item whose words it partly replaces. A basis serves at most BASIS_PASSAGES item passages, about twice its rank, so that each
item keeps a direction of its own. Items that stand in a document word
for word are found without the basis as well, from their rarest word. Candidates are checked by the longest common
subsequence of words, which paraphrases with inserted, dropped or swapped words keep high, and by the words of the
item's answer.

Document frequencies cover all documents; words that are frequent everywhere have no weight, but every item keeps its
rarest words. The basis is fitted on every passage of every document, with the
benchmark given the same mass, so that the directions of its rare words are in the basis; every passage of every
document is searched. The fit needs of the documents only how often two words of the items share a passage, so one job
reads the texts for it, and what it keeps is bounded by the items' words. The benchmark is the stated query set: it is taken in blocks of ITEM_BLOCK items and searched for
SEARCH_PASSAGES passages at once (a longer item alone), which bounds the vocabulary and what is broadcast.

Texts are read in groups: the words of a group are places in its bytes and hashes in arrays, without an object for each. Only
words in the buckets of the items' words are looked up, and only texts with a candidate are split into words.

Cases: null and empty texts and items have no passages and match nothing; a text shorter than a passage is one
passage; repeated documents, items and null ids are all compared and reported per row pair once; an empty table gives
no rows; further columns are ignored; without an ``answer`` column the last sentence of an item is its answer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sized
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import as_bytes, calls, in_workers, map_texts
from quayside.storage import materialise

WINDOW, STRIDE = 32, 16   # words; a passage is two strides
DF_BUCKETS = 1 << 17
RANK, OVERSAMPLE, POWER_ROUNDS, SUM_TASKS = 192, 16, 2, 6
# Passages handled at once.
PART = 512
# Words of texts read at once, unless one text has more, and the bytes counted for a word; pairs of words a task holds.
GROUP_WORDS, WORD_BYTES, HELD_PAIRS = 1 << 16, 8, 1 << 20
MASS = -1
# Items per block.
ITEM_BLOCK = 512
# Item passages of one basis and of one search.
BASIS_PASSAGES, SEARCH_PASSAGES = 384, 1024
LEAST_COSINE = 0.15
# Words of a larger share of the documents have no weight; an item keeps at least so many terms.
MOST_DOCS, ITEM_TERMS = 0.02, 8
LCS_ALONE, LCS_WITH_ANSWER, ANSWER_SHARE = 0.80, 0.50, 0.60
# Lower-case A-Z, every other ASCII sign is a gap.
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them like white space."""
    return text.translate(_PLAIN).split()


SEED = 11
# The factors of XXH64, and the longest word that is hashed together with others: longer ones are read in four lanes.
_A, _B, _C, _D, _E = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                                           2870177450012600261))
MOST_LETTERS = 31


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED) % DF_BUCKETS


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def hashes_of(letters: np.ndarray) -> np.ndarray:
    """XXH64 of words of one length, at most MOST_LETTERS; a row of ``letters`` holds the bytes of a word."""
    number, size = letters.shape
    out = np.full(number, np.uint64(SEED + size) + _E)
    for place in range(0, size - 7, 8):
        lane = np.ascontiguousarray(letters[:, place : place + 8]).view("<u8")[:, 0]
        out = _turned(out ^ _turned(lane * _B, 31) * _A, 27) * _A + _D
    place = size // 8 * 8
    if size - place >= 4:
        lane = np.ascontiguousarray(letters[:, place : place + 4]).view("<u4")[:, 0].astype(np.uint64)
        out = _turned(out ^ lane * _A, 23) * _B + _C
        place += 4
    for place in range(place, size):
        out = _turned(out ^ letters[:, place].astype(np.uint64) * _E, 11) * _A
    out = (out ^ out >> np.uint64(33)) * _B
    out = (out ^ out >> np.uint64(29)) * _C
    return out ^ out >> np.uint64(32)


class Words:
    """Plain words of some texts, in order, without an object for each: where they begin and end in ``plain``, how many each
    text has (``sizes``), and their hashes, whose rest by DF_BUCKETS is the bucket."""

    def __init__(self, texts: list[bytes]):
        self.plain = b" ".join([b"", *texts, b""]).translate(_PLAIN) if texts else b""
        data = np.frombuffer(self.plain, np.uint8)
        solid = data != 32
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        behind = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.sizes = np.diff(np.searchsorted(self.starts, behind), prepend=0)
        self.hashes = np.empty(len(self.starts), np.uint64)
        lengths = np.minimum(self.ends - self.starts, MOST_LETTERS + 1).astype(np.uint8)
        order = np.argsort(lengths, kind="stable")
        cuts = np.cumsum(np.bincount(lengths, minlength=MOST_LETTERS + 2))
        for n in range(1, MOST_LETTERS + 1):
            if len(of := order[cuts[n - 1] : cuts[n]]):
                self.hashes[of] = hashes_of(np.lib.stride_tricks.sliding_window_view(data, n)[self.starts[of]])
        for i in order[cuts[MOST_LETTERS] :].tolist():
            self.hashes[i] = xxhash.xxh64_intdigest(self.word(i), SEED)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, number: int) -> bytes:
        return self.plain[self.starts[number] : self.ends[number]]

    def buckets(self) -> np.ndarray:
        return (self.hashes & np.uint64(DF_BUCKETS - 1)).astype(np.int64)

    def distinct(self) -> np.ndarray:
        """Bucket of each word of each text once. Text and word make one number of 64 bits, whose lowest are the bucket: of
        65,536 words read at once two different ones make the same number once in some billion groups."""
        text = np.repeat(np.arange(len(self.sizes), dtype=np.uint64), self.sizes)
        keys = np.sort(self.hashes + text * _A * np.uint64(DF_BUCKETS))
        return (keys[np.diff(keys, prepend=~keys[:1]) != 0] & np.uint64(DF_BUCKETS - 1)).astype(np.int64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word, summed over the words of a bucket, and documents in all; the buckets bound what reaches
    the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(DF_BUCKETS + 1, np.int64), 0
        for batch in batches:
            for cut in calls(batch):
                for texts in groups(as_bytes(cut.column("text"))):
                    counts += np.bincount(Words(texts).distinct(), minlength=DF_BUCKETS + 1)
                    seen += len(texts)
        counts[DF_BUCKETS] = seen
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    rows = in_workers(docs.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(DF_BUCKETS + 1, np.int64)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(total[:DF_BUCKETS], total[DF_BUCKETS]), int(total[DF_BUCKETS])


@dataclass
class Terms:
    """Vocabulary of the items and the weight of every word."""

    row_of: dict[bytes, int]
    idf: np.ndarray
    common: np.ndarray

    def weights(self, words: list[bytes], rows: np.ndarray) -> np.ndarray:
        """Inverse document frequencies; words of more than MOST_DOCS of the documents weigh nothing, unless an item
        needs them (they have a row)."""
        at = np.fromiter(map(bucket, words), np.int64, len(words))
        return np.where(self.common[at] & (rows < 0), np.float32(0), self.idf[at])

    def loads(self) -> np.ndarray:
        """Weights of the items' words, in the order of their rows."""
        return self.weights(list(self.row_of), np.arange(len(self.row_of)))

    @staticmethod
    def of(items: list[list[bytes]], frequency: np.ndarray, total: int) -> Terms:
        """The items' rare words, and of every item at least its ITEM_TERMS rarest."""
        share = (frequency + 1) / (total + 1)
        chosen: set[bytes] = set()
        for words in items:
            ranked = sorted(set(words), key=lambda x: (share[bucket(x)], x))
            chosen.update(x for i, x in enumerate(ranked) if i < ITEM_TERMS or share[bucket(x)] <= MOST_DOCS)
        return Terms({x: i for i, x in enumerate(sorted(chosen))}, -np.log(share).astype(np.float32) + np.float32(1e-3), share > MOST_DOCS)


class Reader:
    """Finds the rows of the items' words in texts, and the weights of all words."""

    def __init__(self, terms: Terms):
        self.terms, self.asked = terms, np.zeros(DF_BUCKETS, bool)
        self.asked[list(map(bucket, terms.row_of))] = True
        self.light = np.where(terms.common, np.float32(0), terms.idf)

    def rows_and_weights(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``known, rows, weights``: numbers of the words that items know and their rows; weights of all words."""
        at = words.buckets()
        weights, known = self.light[at], np.flatnonzero(self.asked[at])
        ends = zip(words.starts[known].tolist(), words.ends[known].tolist())
        rows = np.fromiter((self.terms.row_of.get(words.plain[a:b], -1) for a, b in ends), np.int64, len(known))
        known, rows = known[rows >= 0], rows[rows >= 0]
        weights[known] = self.terms.idf[at[known]]
        return known, rows, weights

    def passages(self, words: list[bytes], least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``starts, norms`` of the passages; ``places, rows, weights`` of the words that items know.

        No inner product with an item exceeds the norm of a passage's known words: passages below ``least`` of their
        full norm are left out, for they cannot be candidates.
        """
        return self.passages_of([words], least)[1]

    def passages_of(self, texts: list[list[bytes]], least: float = 0.0) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The same of several texts, which are laid one behind the other, each filled up to whole strides and to a passage;
        before them the place where each begins."""
        return self.passages_in(Words([b" ".join(x) for x in texts]), least)

    def passages_in(self, words: Words, least: float = 0.0) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        sizes = words.sizes
        strides = np.maximum(-(-sizes // STRIDE), WINDOW // STRIDE)
        heads = np.cumsum(strides) - strides
        to = np.arange(len(words)) + np.repeat(heads * STRIDE - (np.cumsum(sizes) - sizes), sizes)
        known, rows, weights = self.rows_and_weights(words)
        places, loads = to[known], weights[known]
        number = int(strides.sum())
        squares = np.bincount(to // STRIDE, np.square(weights, dtype=np.float64), number)
        shares = np.bincount(places // STRIDE, np.square(loads, dtype=np.float64), number)
        first = np.ones(number, bool)   # strides that a passage begins with: all but the last of each text
        first[heads + strides - 1] = False
        first = np.flatnonzero(first)
        norms = np.maximum(np.sqrt(squares[first] + squares[first + 1]), 1e-6)
        if least:
            able = shares[first] + shares[first + 1] >= (least * norms) ** 2
            first, norms = first[able], norms[able]
        return heads * STRIDE, (first * STRIDE, norms, places, rows, loads)


def groups_of(texts: list[Sized], most: int | None = None) -> Iterator[slice]:
    """Runs of texts of at most GROUP_WORDS words (``most``: of that length); a longer text is a run of its own."""
    start, held, most = 0, 0, GROUP_WORDS if most is None else most
    for i, words in enumerate(texts):
        if held and held + len(words) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(words)
    if start < len(texts):
        yield slice(start, len(texts))


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts that are read at once."""
    for group in groups_of(texts, WORD_BYTES * GROUP_WORDS):
        yield texts[group]


@dataclass
class Latent:
    """A basis (a row per word, times its weight), and the latent directions of item passages as columns, with the item of each."""

    loadings: np.ndarray
    directions: np.ndarray
    owner: np.ndarray


def similar(passages: tuple[np.ndarray, ...], latent: Latent) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``starts`` of the passages and the cosines between them and the items' directions, a part of the text at a time.

    A passage is projected to the basis, and compared there. Its norm is that of all its words, also of those the
    basis does not know.
    """
    starts, norms, places, rows, _ = passages
    for i in range(0, len(starts), PART):
        some = starts[i : i + PART]
        # A passage is two strides long: sums of strides are made once and added in pairs.
        number = (some - some[0]) // STRIDE
        wanted = np.zeros(number[-1] + 2, bool)
        wanted[number] = wanted[number + 1] = True
        strides, order = some[0] + STRIDE * np.flatnonzero(wanted), np.cumsum(wanted) - 1
        first = np.searchsorted(places, strides)
        size = np.searchsorted(places, strides + STRIDE) - first
        full = size > 0
        if not full.any():
            continue
        held = size[full]
        heads = np.cumsum(held) - held
        at = np.repeat(first[full] - heads, held) + np.arange(held.sum())
        sums = np.zeros((len(strides), latent.loadings.shape[1]), np.float32)
        sums[full] = np.add.reduceat(latent.loadings[rows[at]], heads, axis=0)
        projected = sums[order[number]]
        projected += sums[order[number + 1]]
        # No cosine exceeds the norm that is left in the basis.
        able = np.einsum("ij,ij->i", projected, projected) >= (LEAST_COSINE * norms[i : i + PART]) ** 2
        if able.any():
            yield some[able], (projected[able] / norms[i : i + PART][able, None].astype(np.float32)) @ latent.directions


def product(rows: list[np.ndarray], values: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Sum over passages of ``a (a' Q)``."""
    out = np.zeros_like(q)
    for start in range(0, len(rows), PART):
        sizes = np.array([len(r) for r in rows[start : start + PART]])
        at, x = np.concatenate(rows[start : start + PART]), np.concatenate(values[start : start + PART])
        y = np.add.reduceat(q[at] * x[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
        order = np.argsort(at, kind="stable")
        owner, at, x = np.repeat(np.arange(len(sizes)), sizes)[order], at[order], x[order]
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[heads]] += np.add.reduceat(y[owner] * x[:, None], heads, axis=0)
    return out


def pairs_of(passages: tuple[np.ndarray, ...], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``keys, values``: of every two known words of a passage, as ``smaller row * size + larger row``, one over the squared
    norm of the passage. A word twice in a passage is a pair with itself, once for either order. The values of the key MASS
    add up to the squared normed weights of all known words."""
    starts, norms, places, rows, weights = passages
    for i in range(0, len(starts), 8 * PART):
        first = np.searchsorted(places, starts[i : i + 8 * PART])
        held = np.searchsorted(places, starts[i : i + 8 * PART] + WINDOW) - first
        share = norms[i : i + 8 * PART] ** -2.0
        for n in np.unique(held[held > 0]).tolist():
            of, (a, b) = held == n, np.triu_indices(n)
            at = first[of, None] + np.arange(n)
            found = rows[at]
            yield np.array([MASS]), np.square(weights[at], dtype=np.float64).sum(axis=1)[None] @ share[of]
            left, right = found[:, a], found[:, b]
            value = np.where((left == right) & (a != b), 2.0, 1.0) * share[of, None]
            yield (np.minimum(left, right) * size + np.maximum(left, right)).ravel(), value.ravel()


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sums of their values."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(values), len(found))


def shared_passages(docs: DataFrame, terms: Terms) -> tuple[DataFrame, float]:
    """``i, j, v``: over all passages of all documents, the sum of the products of the normed TF-IDF weights of the rows ``i`` and
    ``j``, in both orders; and the mass of all passages, the sum of their words' squared normed weights."""
    shared, size = docs.sparkSession.sparkContext.broadcast(terms), len(terms.row_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, keys, values, held = Reader(shared.value), [], [], 0

        def batch_of(found: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], ["key", "v"])

        for batch in batches:
            for cut in calls(batch):
                for texts in groups(as_bytes(cut.column("text"))):
                    for found, value in pairs_of(reader.passages_in(Words(texts))[1], size):
                        keys.append(found)
                        values.append(value)
                        held += len(found)
                        if held > HELD_PAIRS:
                            one, total = summed(keys, values)
                            keys, values, held = [one], [total], len(one)
                            if held > HELD_PAIRS // 2:
                                yield batch_of(one, total)
                                keys, values, held = [], [], 0
        if keys:
            yield batch_of(*summed(keys, values))

    loads = terms.loads().astype(np.float64)
    sums = in_workers(docs.select("text"), run, "key long, v double").groupBy("key").agg(F.sum("v").alias("v"))
    both = sums.select(*[F.when(F.col("key") == MASS, MASS).otherwise(F.expr(x)).cast("int").alias(name) for name, x in (
        ("i", f"key div {size}"), ("j", f"key % {size}"))], "v").select(
        F.expr("inline(if(i = j, array(struct(i, j, v)), array(struct(i, j, v), struct(j as i, i as j, v))))"))
    weight = docs.sparkSession.sparkContext.broadcast(loads)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, v = (x.to_numpy() for x in batch.columns)
            v = np.where(i == MASS, v, v * weight.value[i] * weight.value[j])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v)], ["i", "j", "v"])

    pairs = materialise(in_workers(both.repartition(SUM_TASKS, "i").sortWithinPartitions("i", "j"), weighted,
                                   "i int, j int, v double"), "latent-pairs")
    mass = pairs.where(F.col("i") == MASS).select("v").first()
    return pairs.where(F.col("i") != MASS), mass[0] if mass and mass[0] else 1.0


def basis_of(pairs: DataFrame, mass: float, own_rows: list[np.ndarray], own_values: list[np.ndarray], size: int) -> np.ndarray:
    """Right singular vectors of the passage matrix by randomised subspace iteration.

    ``A`` holds the passages of all documents (its columns are the items' words), below it the items' passages with the
    mass of all of them. Each round is one job that multiplies the ``pairs``, which are ``A' A``, by ``Q``, a few columns.
    """
    rank = min(size, RANK + OVERSAMPLE)
    context = pairs.sparkSession.sparkContext
    scale = mass / max(sum(float((x * x).sum()) for x in own_values), 1e-9)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((size, rank)))[0]
    for last in range(POWER_ROUNDS, -1, -1):
        now = context.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, held = np.zeros_like(now.value), np.zeros(size, bool)
            for batch in batches:
                for k in range(0, batch.num_rows, 8 * PART):
                    i, j, v = (x.to_numpy() for x in batch.slice(k, 8 * PART).columns)
                    heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    np.add.at(total, i[heads], np.add.reduceat(now.value[j] * v[:, None], heads, axis=0))
                    held[i] = True
            at = np.flatnonzero(held)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()),
                                                  pa.array([total[at].astype("<f8").tobytes()], pa.binary())], ["at", "part"])

        # A task returns the rows it holds, so that each row reaches the driver once.
        b = scale * product(own_rows, own_values, q)
        for at, part in in_workers(pairs, partial, "at binary, part binary").collect():
            b[np.frombuffer(at, "<i4")] += np.frombuffer(part, "<f8").reshape(-1, rank)
        if last:
            q = np.linalg.qr(b)[0]
    small = q.T @ b
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return np.ascontiguousarray(q @ turn[:, np.argsort(values)[::-1][:RANK]], np.float32)


def directions_of(basis: np.ndarray, own_rows: list[np.ndarray], own_values: list[np.ndarray]) -> np.ndarray:
    """The item passages in the basis, with norm 1, as columns."""
    out = np.stack([basis[at].T @ x for at, x in zip(own_rows, own_values)], axis=1)
    return np.ascontiguousarray(out / np.maximum(np.linalg.norm(out, axis=0), 1e-9), np.float32)


def latent_spaces(docs: DataFrame, items: list[list[bytes]], terms: Terms) -> list[Latent]:
    """Bases for runs of at most BASIS_PASSAGES item passages, and the directions of these."""
    reader = Reader(terms)
    own_rows, own_values, owner = [], [], []
    for number, words in enumerate(items):
        starts, norms, places, rows, weights = reader.passages(words)
        for s, n in zip(starts, norms):
            a, b = np.searchsorted(places, [s, s + WINDOW])
            if b > a:
                own_rows.append(rows[a:b])
                own_values.append(weights[a:b] / np.float32(n))
                owner.append(number)
    pairs, mass = shared_passages(docs, terms)
    loads = terms.loads()
    spaces = []
    for i in range(0, len(owner), BASIS_PASSAGES):
        part = own_rows[i : i + BASIS_PASSAGES], own_values[i : i + BASIS_PASSAGES]
        basis = basis_of(pairs, mass, *part, len(terms.row_of))
        spaces.append(Latent(basis * loads[:, None], directions_of(basis, *part), np.array(owner[i : i + BASIS_PASSAGES])))
    return spaces


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word operation per element of ``b``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Items:
    ids: list
    words: list[list[bytes]]
    answers: list[set[bytes]]
    spaces: list[Latent]
    anchors: dict[int, list[tuple[int, int]]]


def anchors_of(items: list[list[bytes]], terms: Terms) -> dict[int, list[tuple[int, int]]]:
    """Items by the row of their rarest word, with the place of that word in the item."""
    anchors: dict[int, list[tuple[int, int]]] = {}
    for number, words in enumerate(items):
        rarest = max((x for x in words if x in terms.row_of), key=lambda x: (terms.idf[bucket(x)], x))
        anchors.setdefault(terms.row_of[rarest], []).append((number, words.index(rarest)))
    return anchors


def verbatim(items: Items, words: list[bytes], places: np.ndarray, rows: np.ndarray) -> dict[int, int]:
    """Items that stand in the text word for word, and where first."""
    found: dict[int, int] = {}
    for place, row in zip(places.tolist(), rows.tolist()):
        for number, offset in items.anchors.get(row, ()):
            own, start = items.words[number], place - offset
            if number not in found and start >= 0 and words[start] == own[0] and words[start : start + len(own)] == own:
                found[number] = start
    return found


def spans(item: list[bytes], region: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``(lcs, from, to)`` of the stretches of twice the item's length, in steps of half of it."""
    size, step = 2 * len(item), max(1, len(item) // 2)
    for i in range(0, max(1, len(region) - size + step), step):
        yield lcs(item, region[i : i + size]), i, i + size


def check(items: Items, number: int, words: list[bytes], places: np.ndarray) -> tuple[float, float, int] | None:
    """``(lcs share, answer share, place)`` of the best stretch around the candidate passages that convicts by itself."""
    item, answer, reach = items.words[number], items.answers[number], len(items.words[number]) + WINDOW
    best = None
    groups = np.split(places, np.flatnonzero(np.diff(places) > reach) + 1)
    for group in groups:
        start = max(0, int(group[0]) - reach)
        region = words[start : int(group[-1]) + WINDOW + reach]
        for most, a, b in spans(item, region):
            found = most / len(item)
            if found < min(LCS_ALONE, LCS_WITH_ANSWER):
                continue
            share = len(answer.intersection(region[a:b])) / len(answer) if answer else 1.0
            if found >= LCS_ALONE or found >= LCS_WITH_ANSWER and share >= ANSWER_SHARE:
                best = max(best or (-1.0, 0.0, 0), (found, share, -start - a))
    return best and (best[0], best[1], -best[2])


_readers: dict = {}


def matches(items: Items, reader: Reader, anchored: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
    """The rows of some texts, by their numbers; ``anchored`` says whether a row is an anchor. Only texts with an anchor or
    a candidate are taken apart into words."""
    heads, passages = reader.passages_in(Words(texts), LEAST_COSINE)
    words_of: dict[int, list[bytes]] = {}
    near: dict[tuple[int, int], dict[int, float | None]] = {}
    _, _, places, rows, _ = passages
    anchor = anchored[rows]
    places, rows = places[anchor], rows[anchor]
    owner = np.searchsorted(heads, places, side="right") - 1
    for text in np.unique(owner).tolist():
        own = owner == text
        words_of[text] = plain_words(texts[text])
        for number, start in verbatim(items, words_of[text], places[own] - heads[text], rows[own]).items():
            near[text, number] = {start: None}
    for latent in items.spaces:
        for starts, cosine in similar(passages, latent):
            i, j = np.nonzero(cosine >= LEAST_COSINE)
            owner = np.searchsorted(heads, starts[i], side="right") - 1
            for text, number, place, value in zip(owner.tolist(), latent.owner[j].tolist(), (starts[i] - heads[owner]).tolist(), cosine[i, j].tolist()):
                at = near.setdefault((text, number), {})
                at[place] = max(at.get(place) or 0.0, value)
    for (text, number), at in near.items():
        if text not in words_of:
            words_of[text] = plain_words(texts[text])
        if best := check(items, number, words_of[text], np.array(sorted(at))):
            yield text, items.ids[number], max((x for x in at.values() if x is not None), default=None), *best


def search(docs: DataFrame, terms: Terms, items: Items, kind: str) -> DataFrame:
    shared, token = docs.sparkSession.sparkContext.broadcast((terms, items)), uuid.uuid4().hex

    def make(batch: pa.RecordBatch) -> dict:
        known, asked = shared.value
        if token not in _readers:
            _readers.clear()
            _readers[token] = Reader(known), np.isin(np.arange(len(known.row_of)), list(asked.anchors))
        out = []
        ids = iter(batch.column("doc_id").to_pylist())
        for texts in groups(as_bytes(batch.column("text"))):
            named = list(islice(ids, len(texts)))
            out += [(named[text], *found) for text, *found in matches(asked, *_readers[token], texts)]
        columns = list(zip(*out)) or [[]] * 6
        return dict(zip(("doc_id", "item_id", "cosine", "lcs_share", "answer_share", "word_at"), columns))

    return map_texts(docs, make, f"doc_id long, item_id {kind}, cosine double, lcs_share double, answer_share double, word_at long")


def searches(items: list[list[bytes]]) -> list[slice]:
    """Runs of items of at most SEARCH_PASSAGES passages; a longer item is a run of its own."""
    sizes = [len(range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)) for x in items]
    cuts, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > SEARCH_PASSAGES:
            cuts.append(i)
            held = 0
        held += n
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(items)]) if b > a]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share, word_at`` of every document that holds an item.

    ``cosine`` is null where no passage reaches LEAST_COSINE and the item was found word for word only.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = dict(benchmark.dtypes)["item_id"]
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = benchmark.select("item_id", F.col("text").alias("item_text"), answer.alias("answer")).distinct()
    blocks = max(1, -(-listed.count() // ITEM_BLOCK))
    frequency, total = document_frequency(docs)
    found = []
    for block in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block).orderBy("item_id", "item_text").collect()
        ids, words, answers = [], [], []
        for item_id, text, given in rows:
            own = plain_words((text or "").encode())
            if own:
                sentences = [x for x in _SENTENCE.split((text or "").encode()) if plain_words(x)]
                ids.append(item_id)
                words.append(own)
                answers.append(set(plain_words(given.encode() if given else sentences[-1])))
        for part in searches(words):
            own = words[part]
            terms = Terms.of(own, frequency, total)
            asked = Items(ids[part], own, answers[part], latent_spaces(docs, own, terms), anchors_of(own, terms))
            found.append(search(docs, terms, asked, kind))
    if not found:
        return spark.createDataFrame([], f"doc_id long, item_id {kind}, cosine double, lcs_share double, answer_share double, word_at long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
