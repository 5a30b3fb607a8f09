"""Katz back-off scoring: Good-Turing discounted bigram and unigram counts with exactly normalised back-off weights.

``P(w|h) = d(c) c(h,w) / c(h)`` for a pair seen in training, else ``alpha(h) P(w)``; ``P(w) = d(c) c / N`` for a known
word, and the unigram mass that discounting frees belongs to the unknown word. Counts up to CUTOFF are discounted by
Katz's formula; above it a share ``1 / (N + 1)`` is set aside, so that every history keeps some mass for other words.
An unknown history leaves ``P(w)``. The end of a text is a token, its start a history.

How it runs. A token is never a row. Tasks turn their documents into blocks (token numbers of a few million tokens,
packed). Words of blocks meet by word hash: counts are summed, and every block gets the counts and numbers of its own
words back. Blocks then send each pair once, with the documents that hold it, to the task of its history; histories
with more than a share of all tokens are dealt by pair instead. There the pairs are counted and all that does not
depend on global discounts is summed per document; what does (how many pairs of each small count, which histories
were backed off from, and their discounted mass) is written beside it and finished once the counts of counts are
known. Only counts of counts and the few dealt histories reach the driver.

Stored tables: ``unigrams`` (kind 1: hashes and counts, by hash class) and ``pairs`` (kind 5: pairs and counts, by
history), both partitioned by kind.

Cases: a null or empty text is the end token alone; a null id is in no fold and trains; repeated rows count and are
scored each; with nothing to train on every word is the unknown word; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import as_bytes, calls, fold, in_workers, lower_words_of, pack, unpack
from quayside.storage import delete_path, fresh_path, source_bytes

FOLDS, HELD_FOLD, CUTOFF = 10, 0, 5
BLOCK_TOKENS, PART_ENTRIES, CLASS_BYTES = 1_500_000, 1_600_000, 16 << 20
BASE = 0.1
START, FIRST_NUMBER = 1, 2
SCHEMA = "kind int, p int, block long, a array<long>, f array<double>, b array<binary>"
_KIND = pa.schema([("kind", pa.int32()), ("p", pa.int32()), ("block", pa.int64()), ("a", pa.list_(pa.int64())),
                   ("f", pa.list_(pa.float64())), ("b", pa.list_(pa.binary()))])
TEXTS, WORDS = 0, 1
REPLIES, UNIGRAMS, COUNTS = 0, 1, 2
DOCS, SUMS, BACKED, DEALT, DEALT_BACKED, PAIRS, PAIR_COUNTS = 0, 1, 2, 3, 4, 5, 6
_STATS = CUTOFF + 2  # pairs of each small count, tokens of larger ones, unigram mass


def _row(kind: int, p: int = 0, block: int = 0, a=None, f=None, b=()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x], t) for x, t in zip((kind, p, block, a if a is not None else [], f if f is not None else [], list(b)), _KIND.types)],
        schema=_KIND)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not len(values) or values.max() < 2**32 else values


def _floats(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<f8").tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def discounts(n: np.ndarray, total: int) -> np.ndarray:
    """``d[0..CUTOFF + 1]``: factor of each count, the last one of all larger counts. ``n[r]`` words have count r.

    Katz's formula where it gives a proper factor, else half a count less.
    """
    most = total / (total + 1)
    d = np.full(CUTOFF + 2, most)
    tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        found = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) if n[r] and tail != 1 else -1.0
        d[r] = min(found if 0 < found < 1 else (r - 0.5) / r, most)
    return d


class Unigrams:
    """``P(w)`` as a function of the count of w; count 0 is the unknown word."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.total = sum(c * n for c, n in counts)
        self.words = sum(n for _, n in counts)
        n = np.zeros(CUTOFF + 2)
        for c, k in counts:
            if c <= CUTOFF + 1:
                n[c] = k
        self.d = discounts(n, self.total)
        known = sum(k * c * self.d[min(c, CUTOFF + 1)] for c, k in counts) / max(self.total, 1)
        self.unknown = 1.0 - known

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.d[np.minimum(counts, CUTOFF + 1).astype(np.int64)] * counts / max(self.total, 1), self.unknown)


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _blocks(docs: DataFrame, classes: int) -> DataFrame:
    """Kind TEXTS: ids ``a``, ``b``: training flags, lengths, tokens, hash classes of the local words. Kind WORDS, per
    hash class: hashes and training counts of the local words, in local order."""
    def emit(ids: _Numbers, texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([x[2] for x in texts])
        train = np.array([x[1] for x in texts], bool)
        lengths = np.array([len(x[2]) for x in texts])
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in ids], np.uint64)
        order = np.argsort(-np.bincount(tokens, minlength=len(ids)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens, hashes = place[tokens], hashes[order]
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(ids))
        own = (hashes % np.uint64(classes)).astype(np.int64)
        block = secrets.randbits(62)
        yield _row(TEXTS, 0, block, [x[0] for x in texts], None, (pack(train), pack(lengths), pack(tokens), pack(own)))
        by_class = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[by_class], np.arange(classes + 1))
        for q in range(classes):
            at = by_class[edges[q] : edges[q + 1]]
            if len(at):
                yield _row(WORDS, q, block, None, None, (hashes[at].astype("<u8").tobytes(), pack(counts[at])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = _Numbers({b" ": 0}), [], 0  # a blank is no word: it stands for the end
        for batch in batches:
            for cut in calls(batch):
                for doc_id, train, text in zip(cut.column("doc_id").to_pylist(), cut.column("train").to_pylist(), as_bytes(cut.column("text"))):
                    words = lower_words_of(text)
                    words.append(b" ")
                    texts.append((doc_id, train, np.fromiter(map(ids.__getitem__, words), np.int64, len(words))))
                    size += len(words)
                    if size >= BLOCK_TOKENS:
                        yield from emit(ids, texts)
                        ids, texts, size = _Numbers({b" ": 0}), [], 0
        if texts:
            yield from emit(ids, texts)

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_FOLD, F.lit(True)).alias("train"), "text")
    return in_workers(rows, run, SCHEMA)


def _unigrams(words: DataFrame, classes: int) -> DataFrame:
    """Kind REPLIES per block and class: counts and ranks of the block's words. Kind UNIGRAMS: the table. Kind COUNTS:
    how many words have each count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows.setdefault(row["p"], []).append((row["block"], np.frombuffer(row["b"][0], "<u8"), unpack(row["b"][1])))
        for q, own in rows.items():
            found, inverse = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([x[2] for x in own]).astype(float)).astype(np.int64)
            rank = np.empty(len(found), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(found))
            at = 0
            for block, hashes, _ in own:
                mine = inverse[at : at + len(hashes)]
                at += len(hashes)
                yield _row(REPLIES, q, block, None, None, (pack(total[mine]), pack(rank[mine])))
            yield _row(UNIGRAMS, q, 0, None, None, (found.tobytes(), pack(total)))
            values, n = np.unique(total[total > 0], return_counts=True)
            yield _row(COUNTS, q, 0, values.tolist(), n.astype(float).tolist())

    return in_workers(words.repartition(classes, "p"), run, SCHEMA)


def _requests(texts: DataFrame, replies: DataFrame, classes: int, parts: int, uni: Unigrams) -> DataFrame:
    """Kind DOCS per block: per-document counts and sums. Kind 1 per part: histories, their pairs, the pairs'
    documents."""
    starts_seen = F.collect_list(F.struct("p", "b")).alias("replies")
    grouped = replies.groupBy(F.col("block").alias("of")).agg(starts_seen)
    joined = texts.join(grouped, texts["block"] == grouped["of"]).select("block", "a", "b", "replies")
    hot = max(1, uni.total // (4 * parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                train, lengths, tokens, own = (unpack(x) for x in row["b"])
                tokens, lengths = tokens.astype(np.int64), lengths.astype(np.int64)
                count, number = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                for reply in row["replies"]:
                    at = np.flatnonzero(own == reply["p"])
                    count[at] = unpack(reply["b"][0])
                    number[at] = unpack(reply["b"][1]).astype(np.int64) * classes + reply["p"] + FIRST_NUMBER
                number[count == 0] = 0
                ends = np.cumsum(lengths)
                heads = ends - lengths
                document = np.repeat(np.arange(len(lengths)), lengths)
                c = count[tokens]
                total = uni.total + BASE * (uni.words + 1)
                add = np.add.reduceat
                # local numbers of histories: the words', and one more for the start
                before = np.r_[len(own), tokens[:-1]]
                before[heads] = len(own)
                all_numbers = np.r_[number, START if uni.total else 0]
                all_counts = np.r_[count, count[tokens[ends[0] - 1]]]  # as many starts as ends
                if not all_counts[-1]:
                    all_numbers[-1] = 0  # nothing was trained
                blind = all_numbers[before] == 0
                yield _row(DOCS, int(row["block"] % parts), row["block"], row["a"], None, (
                    pack(train), pack(lengths), pack(add((c > 0).astype(np.int64), heads)), _floats(add(np.log10((c + BASE) / total), heads)),
                    _floats(add(np.where(blind, np.log10(uni(c)), 0.0), heads))))
                kept = np.flatnonzero(~blind)
                h, w, document = before[kept], tokens[kept], document[kept]
                spread = _mixed(all_numbers[h])
                often = all_counts[h] > hot
                spread[often] = _mixed(spread[often] ^ (number[w[often]].astype(np.uint64) << np.uint64(17)))
                p = (spread % np.uint64(parts)).astype(np.int64)
                size = len(own) + 1
                code = (p * size + h) * size + w
                order = np.argsort(code, kind="stable")
                code, document = code[order], document[order]
                pair = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
                pair_n = np.diff(np.r_[pair, len(code)])
                pair_code = code[pair]
                pair_w, pair_h, pair_p = pair_code % size, pair_code // size % size, pair_code // size // size
                edges = np.searchsorted(pair_p, np.arange(parts + 1))
                reach = np.r_[0, np.cumsum(pair_n)]
                flags = np.packbits(train.astype(bool)).tobytes()
                for q in range(parts):
                    a, b = edges[q], edges[q + 1]
                    if a < b:
                        hs = pair_h[a:b]
                        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
                        yield _row(1, q, row["block"], [len(lengths)], None, (
                            pack(all_numbers[hs[first]]), pack(all_counts[hs[first]]), pack(np.diff(np.r_[first, b - a])),
                            pack(number[pair_w[a:b]]), pack(count[pair_w[a:b]]), pack(pair_n[a:b]),
                            pack(document[reach[a] : reach[b]]), flags))

    return in_workers(joined, run, SCHEMA).repartition(parts, "p")


def _counted(requests: DataFrame, parts: int, uni: Unigrams) -> DataFrame:
    hot = max(1, uni.total // (4 * parts))
    largest = np.log10(uni.total / (uni.total + 1)) if uni.total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            own = batch.column("kind").to_numpy()
            if (own == DOCS).any():
                yield batch.filter(pa.array(own == DOCS))
            for i in np.flatnonzero(own == 1):
                x = batch.slice(int(i), 1).to_pylist()[0]
                rows.append((x["block"], x["a"][0], [_narrow(unpack(y)) for y in x["b"][:7]], x["b"][7]))
        if not rows:
            return
        flags = [np.unpackbits(np.frombuffer(x[3], np.uint8), count=x[1]).astype(np.float64) for x in rows]
        trained = np.concatenate([np.add.reduceat(t[b[6].astype(np.int64)], np.r_[0, np.cumsum(b[5].astype(np.int64))[:-1]])
                                  for (_, _, b, _), t in zip(rows, flags)])
        h_number = np.concatenate([np.repeat(b[0], b[2].astype(np.int64)) for _, _, b, _ in rows])
        hs, h_at, h_first = _distinct(h_number)
        ch = np.concatenate([np.repeat(b[1], b[2].astype(np.int64)) for _, _, b, _ in rows])[h_first].astype(np.int64)
        del h_number
        ws, w_at, _ = _distinct(np.concatenate([b[3] for _, _, b, _ in rows]))
        w_at = w_at.astype(np.uint64)
        w_at += h_at.astype(np.uint64) * np.uint64(len(ws))
        pairs, at, first = _distinct(w_at)
        del w_at
        c2 = np.bincount(at, trained, len(pairs)).astype(np.int64)
        of, cw = h_at[first], np.concatenate([b[4] for _, _, b, _ in rows])[first].astype(np.int64)
        at, h_at = _narrow(at), None
        seen = c2 > 0
        small = np.minimum(c2, CUTOFF + 1)
        stats = np.stack([*(np.bincount(of[seen & (small == r)], minlength=len(hs)) for r in range(1, CUTOFF + 1)),
                          np.bincount(of, np.where(small > CUTOFF, c2, 0), len(hs)),
                          np.bincount(of, np.where(seen, uni(cw), 0.0), len(hs))], axis=1)
        value = np.where(seen, np.log10(np.maximum(c2, 1) / np.maximum(ch[of], 1)) + np.where(small > CUTOFF, largest, 0.0), np.log10(uni(cw)))
        yield _row(PAIR_COUNTS, 0, 0, None, np.bincount(small, minlength=CUTOFF + 2)[: CUTOFF + 1].astype(float).tolist()
                   + [float((c2 == CUTOFF + 1).sum())])
        kept = np.flatnonzero(seen)
        yield _row(PAIRS, 0, 0, None, None, (pack(hs), pack(of[kept]), pack(ws[(pairs[kept] % np.uint64(len(ws))).astype(np.int64)]), pack(c2[kept])))
        often = ch > hot
        start, blocks, b_document, b_history, b_block = 0, [], [], [], []
        for block, size, b, _ in rows:
            mine = at[start : start + len(b[3])]
            start += len(b[3])
            n, document = b[5].astype(np.int64), b[6].astype(np.int64)
            mine = np.repeat(mine, n)
            present = np.flatnonzero(np.bincount(document, minlength=size))
            classes = [np.bincount(document[small[mine] == r], minlength=size)[present] for r in range(1, CUTOFF + 1)]
            yield _row(SUMS, 0, block, [size], None, (
                pack(np.diff(present, prepend=0)), _floats(np.bincount(document, value[mine], size)[present]), *(pack(x) for x in classes)))
            back = np.flatnonzero(~seen[mine])
            history = of[mine[back]]
            dealt = often[history]
            if dealt.any():
                yield _row(DEALT_BACKED, 0, block, [size], None, (pack(document[back[dealt]]), pack(hs[history[dealt]])))
            b_document.append(document[back[~dealt]])
            b_history.append(history[~dealt])
            b_block.append(np.full(len(b_document[-1]), len(blocks) // 2))
            blocks += [block, size]
        history = np.concatenate(b_history)
        needed, local = np.unique(history, return_inverse=True)
        yield _row(BACKED, 0, 0, blocks, None, (pack(np.concatenate(b_block)), pack(np.concatenate(b_document)), pack(local),
                                                _floats(np.c_[stats[needed], ch[needed]])))
        if often.any():
            yield _row(DEALT, 0, 0, hs[often].astype(np.int64).tolist(), np.c_[stats[often], ch[often]].ravel().tolist())

    return in_workers(requests, run, SCHEMA)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of each value among them, the first place of each."""
    found, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    return found.astype(np.uint64), inverse.ravel(), first


def alphas(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Back-off weights of histories from their pairs of each small count, larger tokens, unigram mass and count."""
    small = stats[:, :CUTOFF] @ (d[1 : CUTOFF + 1] * np.arange(1, CUTOFF + 1)) + stats[:, CUTOFF] * d[CUTOFF + 1]
    left = 1 - small / np.maximum(stats[:, CUTOFF + 2], 1)
    return np.maximum(left, 1e-12) / np.maximum(1 - stats[:, CUTOFF + 1], 1e-12)


def _finished(pieces: DataFrame, d: np.ndarray, dealt: dict[int, float], parts: int) -> DataFrame:
    """Document sums of what the discounts decide, gathered by block."""
    logs = np.log10(d)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b, kind = row["b"], row["kind"]
                if kind == DOCS:
                    yield batch.slice(i, 1).select(_KIND.names)
                elif kind == SUMS:
                    total = np.frombuffer(b[1], "<f8").copy()
                    for r in range(1, CUTOFF + 1):
                        total += unpack(b[1 + r]) * logs[r]
                    yield _row(SUMS, 0, row["block"], None, None, (b[0], _floats(total)))
                elif kind == DEALT_BACKED:
                    add = np.array([dealt[int(x)] for x in unpack(b[1])])
                    total = np.bincount(unpack(b[0]).astype(np.int64), np.log10(add), row["a"][0])
                    at = np.flatnonzero(total)
                    yield _row(SUMS, 0, row["block"], None, None, (pack(np.diff(at, prepend=0)), _floats(total[at])))
                else:
                    add = np.log10(alphas(np.frombuffer(b[3], "<f8").reshape(-1, _STATS + 1), d))
                    of, document, local = (unpack(x).astype(np.int64) for x in b[:3])
                    blocks, sizes = row["a"][::2], row["a"][1::2]
                    for j in np.unique(of):
                        at = of == j
                        total = np.bincount(document[at], add[local[at]], sizes[j])
                        there = np.flatnonzero(total)
                        yield _row(SUMS, 0, blocks[j], None, None, (pack(np.diff(there, prepend=0)), _floats(total[there])))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict = {}
        pending: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == DOCS:
                    docs[row["block"]] = (row["a"], row["b"])
                else:
                    at = np.cumsum(unpack(row["b"][0]).astype(np.int64))
                    pending.setdefault(row["block"], []).append((at, np.frombuffer(row["b"][1], "<f8")))
        for block, (ids, b) in docs.items():
            score = np.frombuffer(b[4], "<f8").copy()
            for at, x in pending.get(block, []):
                np.add.at(score, at, x)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(~unpack(b[0]).astype(bool)), pa.array(unpack(b[1]).astype(np.int64)),
                pa.array(unpack(b[2]).astype(np.int64)), pa.array(np.frombuffer(b[3], "<f8")), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    done = in_workers(pieces, finish, SCHEMA).repartition(parts, "block")
    return in_workers(done, gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def katz_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document (log10)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = max(least, -(-(source_bytes(docs) or 0) // CLASS_BYTES))

    def stored(rows: DataFrame, label: str) -> str:
        path = fresh_path(spark, label)
        rows.write.partitionBy("kind").parquet(path)
        return path

    def kinds(path: str, *wanted: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(path).where(F.col("kind").isin(*wanted)).select(*_KIND.names)

    blocks = stored(_blocks(docs, classes), "katz-blocks")
    unigrams = stored(_unigrams(kinds(blocks, WORDS), classes), "katz-unigrams")
    delete_path(spark, f"{blocks}/kind={WORDS}")
    listed = kinds(unigrams, COUNTS).select(F.explode(F.arrays_zip("a", "f")).alias("x")).groupBy(F.col("x.a").alias("c")).agg(
        F.sum("x.f").cast("long").alias("n"))
    uni = Unigrams([(c, n) for c, n in listed.collect()])  # at most sqrt(2 N) different counts
    parts = max(least, -(-uni.total // PART_ENTRIES))
    requests = _requests(kinds(blocks, TEXTS), kinds(unigrams, REPLIES), classes, parts, uni)
    pairs = stored(_counted(requests, parts, uni), "katz-pairs")
    delete_path(spark, blocks)
    n = kinds(pairs, PAIR_COUNTS).select(*[F.sum(F.col("f")[r]).alias(f"n{r}") for r in range(CUTOFF + 2)]).first()
    d = discounts(np.array([x or 0.0 for x in n]), uni.total)
    each = kinds(pairs, DEALT).select(F.posexplode("a").alias("i", "h"), "f")
    sums = each.groupBy("h").agg(*[F.sum(F.col("f")[F.col("i") * (_STATS + 1) + j]).alias(f"s{j}") for j in range(_STATS)],
                                 F.max(F.col("f")[F.col("i") * (_STATS + 1) + _STATS]).alias("count")).collect()
    stats = np.array([list(x)[1:] for x in sums]).reshape(-1, _STATS + 1)
    dealt = dict(zip([x["h"] for x in sums], alphas(stats, d).tolist()))  # at most 4 per part
    scored = _finished(kinds(pairs, DOCS, SUMS, BACKED, DEALT_BACKED), d, dealt, parts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")
