"""Token counts by the whole-token shortcut.

For every vocabulary string that can stand as a whole pre-token it is proved, once per job and against the real
merges, that it encodes alone as one token. Pre-tokens in this set count one without any merging; only the rest goes
through the merge loop of the tokenizer. A chunk between ASCII white space is the unit of work: neither the
normaliser nor the pre-tokenizer nor a special token reaches over white space, so counts of chunks add up.

Cases: null and empty texts have no tokens; special strings inside a text are the special token, as the library does
by default; repeated rows count alike; null ids are carried through; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import json

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from quayside.llm.common import Memo, as_bytes, map_texts
from quayside.llm.pretokens import PreTokens, tokenizer_at

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
# Distinct chunks and pre-tokens remembered by one Python worker.
MEMO_CHUNKS, MEMO_PIECES = 500_000, 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

def proved_whole(path: str) -> frozenset[str]:
    """Vocabulary strings, as pre-tokens, that the merges turn into exactly their own token."""
    model = tokenizer_at(path).model
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    suffix = described["model"].get("end_of_word_suffix") or ""
    special = {x["content"] for x in described["added_tokens"]}
    proved = set()
    for entry, number in described["model"]["vocab"].items():
        if entry.endswith(suffix) and len(entry) > len(suffix) and entry not in special:
            piece = entry[: len(entry) - len(suffix)]
            tokens = model.tokenize(piece)
            if len(tokens) == 1 and tokens[0].id == number:
                proved.add(piece)
    return frozenset(proved)


class ChunkCounter:
    """Tokens of one chunk: whole pre-tokens are looked up, the rest is merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        tokenizer = tokenizer_at(path)
        self.encode, self.pre_tokens = tokenizer.encode, PreTokens(path)
        merge = tokenizer.model.tokenize
        self.count = Memo(lambda piece: 1 if piece in whole else len(merge(piece)), MEMO_PIECES).__getitem__

    def __call__(self, chunk: bytes) -> int:
        pieces = self.pre_tokens(chunk)
        if pieces is None:
            return len(self.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return sum(map(self.count, pieces))


_counters: dict = {}


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document with its bytes and tokens. One pass, no shuffle; the proof (bounded by the vocabulary)
    is made on the driver and travels with the task."""
    path = path or public_tokenizers.path(VOCABULARY)
    whole = docs.sparkSession.sparkContext.broadcast(proved_whole(path))

    def make(batch: pa.RecordBatch) -> dict:
        if path not in _counters:
            _counters[path] = Memo(ChunkCounter(path, whole.value), MEMO_CHUNKS)
        count = _counters[path].__getitem__
        texts = as_bytes(batch.column("text"))
        tokens = [sum(map(count, x.split())) for x in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in texts], "n_tokens": tokens,
                "over_limit": [x > limit for x in tokens]}

    return map_texts(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, SCHEMA)
