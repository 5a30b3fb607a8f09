"""Operators on single texts: compression bands, token counts, packing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import zstandard
from tokenizers import Tokenizer

from quayside.llm import curve_packing
from quayside.llm.compression_bands import BANDS, base_counts, compression_bands, within_bands
from quayside.llm.curve_packing import hilbert_key, pack_along_curve
from quayside.llm.pretokens import PreTokens
from quayside.llm.token_counts import proved_whole, token_counts

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def brute_base(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def check_bands(rows, found):
    wanted = []
    for doc_id, text in rows:
        base = brute_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        raw = (text or "").encode()
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw)) / len(raw) if raw else 1.0
        low, high = [x[1:] for x in BANDS if x[0] <= len(raw)][-1]
        wanted.append((doc_id, *base, failed, round(ratio, 9), bool(raw) and low <= ratio <= high))
    got = [(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, round(x.ratio, 9),
            x.verdict not in ("repetitive", "incompressible", "empty")) for x in found]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert all(x.kept == (not x.base_failed and x.verdict == "pass") for x in found)


def test_bands_equal_brute_force(small, docs_of, odd_rows):
    check_bands([(x.doc_id, x.text) for x in small.collect()], compression_bands(small).collect())
    check_bands(odd_rows, compression_bands(docs_of(odd_rows)).collect())


def test_bands_reject_both_ends(docs_of):
    rng = np.random.default_rng(0)
    noise = " ".join("".join(map(chr, rng.integers(33, 127, 40))) for _ in range(400))
    prose = " ".join("".join(map(chr, 97 + rng.geometric(0.2, 6) % 26)) for _ in range(3000))
    rows = [(1, noise), (2, "again and again " * 2000), (3, prose)]
    assert {x.doc_id: (x.kept, x.verdict) for x in compression_bands(docs_of(rows)).collect()} == {
        1: (False, "incompressible"), 2: (False, "repetitive"), 3: (True, "pass")}
    kept = within_bands(docs_of(rows))
    assert kept.schema == docs_of(rows).schema and [x.doc_id for x in kept.collect()] == [3]


def test_repeated_windows_count_words_once():
    assert base_counts(b"a b c a b c a b c")[4] == 9 and base_counts(b"a b c d")[4] == 0 and base_counts(b"a a a a")[4] == 4


def test_token_counts_equal_the_library(small, docs_of, odd_rows, tokenizer):
    for rows, df in (([(x.doc_id, x.text) for x in small.collect()], small), (odd_rows, docs_of(odd_rows))):
        wanted = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
        assert sorted(map(tuple, token_counts(df).collect()), key=repr) == sorted(wanted, key=repr)


def test_proof_holds_and_covers_common_words(tokenizer):
    whole = proved_whole(PATH)
    assert "the" in whole and "<|endoftext|>" not in whole
    assert all(len(tokenizer.encode(x, add_special_tokens=False).ids) == 1 for x in list(whole)[:500] if x.isascii() and x.isalpha())


def check_packing(rows, pieces, tokenizer, length):
    """Every id lies in one piece, pieces fill sequences without a gap, and only the last sequence is short."""
    wanted = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    assert sum(x.length for x in pieces) == sum(len(ids) * n for (_, ids), n in wanted.items())
    assert all(zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length for x in pieces)
    by_sequence: dict = {}
    for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == by_sequence.get(x.sequence_id, 0)
        by_sequence[x.sequence_id] = x.offset + x.length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(n == length for s, n in by_sequence.items() if s + 1 < len(by_sequence))
    found: Counter = Counter()
    parts: list = []
    for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset)):
        parts = parts + x.ids if x.start else list(x.ids)
        if x.start + x.length == x.doc_tokens:
            found[x.doc_id, tuple(parts)] += 1
    assert found == wanted


def test_packing_keeps_every_id(small, docs_of, odd_rows, tokenizer):
    for rows, df in (([(x.doc_id, x.text) for x in small.collect()], small), (odd_rows, docs_of(odd_rows))):
        check_packing(rows, pack_along_curve(df, with_ids=True).collect(), tokenizer, 4096)
    assert pack_along_curve(docs_of([])).count() == 0


def test_chunks_are_split_like_the_library_splits_them(tokenizer, monkeypatch):
    """Single words with marks after them need no pattern; marks, digits, apostrophes, special tokens and other scripts do."""
    rng, pre = random.Random(1), PreTokens(public_tokenizers.path("word_bpe_49k.json"))
    split = lambda x: [a for a, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(x))]
    signs = "abcXYZ'>|.,!?#*\"éİßÉ\u0301日1²ªʰ\u024f\u0250\x7f-"
    chunks = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 7))) for _ in range(20000)]
    assert all(pre(x.encode()) == split(x) for x in chunks)
    assert pre(b"a<|endoftext|>.") is None and pre(b"a<b.") == split("a<b.")
    words = ["word", "Word,", "É", "éßÉ.", "x***", 'end?!"']

    def never(text):
        raise AssertionError(text)

    monkeypatch.setattr(pre, "find", never)
    monkeypatch.setattr(pre, "split", never)
    assert [pre(x.encode()) for x in words] == [split(x) for x in words]


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = grid[np.argsort(hilbert_key(grid, 3))]
    assert sorted(hilbert_key(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_alike_documents_are_near_on_the_curve(docs_of):
    rows = [(i, " ".join(["alpha beta gamma delta", "uno dos tres cuatro"][i % 2].split()[j % 4] for j in range(50 + i))) for i in range(40)]
    pieces = sorted(pack_along_curve(docs_of(rows)).collect(), key=lambda x: (x.sequence_id, x.offset))
    kinds = [x.doc_id % 2 for x in pieces if x.start == 0]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) <= 8
    assert curve_packing.LENGTH == 4096
