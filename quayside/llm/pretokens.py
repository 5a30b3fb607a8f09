"""Tokenizer access shared by the operators that count or need token ids: chunks, pre-tokens, merges."""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode

import regex

# The pre-token pattern of the vocabulary file, and the byte alphabet of byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch
# ASCII marks without the apostrophe, which may begin a pre-token with letters, and "<", which begins a special token.
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_loaded: dict = {}


def tokenizer_at(path: str):
    """One tokenizer per worker and file."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def byte_alphabet() -> dict[int, str]:
    """Byte value -> the character that stands for it: itself where printable, else the next one from 256 on."""
    others = [x for x in range(256) if x not in set(_PLAIN)]
    return {x: chr(x) for x in _PLAIN} | {x: chr(256 + i) for i, x in enumerate(others)}


class PreTokens:
    """Pre-tokens of a chunk that holds no ASCII white space, in the byte alphabet; None if a special token is inside.

    Printable Latin text (below U+0250) has one form in NFC and a lower case per character, so it needs only a
    pattern match, and none if it is one word, with or without ASCII marks after it; everything else goes through the
    tokenizer's own normaliser and pre-tokenizer.
    """

    def __init__(self, path: str):
        tokenizer = tokenizer_at(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [x["content"] for x in described["added_tokens"]]
        own = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(PATTERN).findall if own == PATTERN else None
        self.quick = self.find is not None and all("<" in x for x in self.special)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        alphabet = byte_alphabet()
        self.alphabet = "".join(alphabet[x] for x in range(256))

    def spelt(self, piece: str) -> str:
        """The bytes of a piece in the byte alphabet."""
        return charmap_decode(piece.encode(), "strict", self.alphabet)[0]

    def __call__(self, chunk: bytes) -> list[str] | None:
        if self.quick:
            bare = chunk.rstrip(_MARKS)
            if bare.isalpha():   # ASCII letters only, as these are bytes
                word = bare.lower().decode()
            else:
                word = bare.decode("utf-8", "replace")
                word = self.spelt(word.lower()) if word.isalpha() and _LATIN(word) else ""
            if word:
                return [word] if len(bare) == len(chunk) else [word, chunk[len(bare) :].decode()]
        text = chunk.decode("utf-8", "replace")
        if self.find and _LATIN(text) and text.isprintable():
            if text.isalpha():
                pieces = [text.lower()]
            elif "<" in text and any(x in text for x in self.special):
                return None
            else:
                pieces = self.find(text.lower())
            return pieces if text.isascii() else [x if x.isascii() else self.spelt(x) for x in pieces]
        if any(x in text for x in self.special):
            return None
        return [x for x, _ in self.split(self.normalise(text))]
