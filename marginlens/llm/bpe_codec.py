"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library with the given ranks and split
pattern, without special tokens, and decoded to raw bytes. Texts over
``LONG`` characters are cut at places where no match of the pattern can
span: between a letter and a following ASCII character that isn't one. Long
runs of white space, on which the library's matcher runs out of stack, are
cut by the pattern's own rule (all but the last character, or all at the end
of the text, is one match) and merged as one piece.

Null text counts as empty: no tokens. Repeated rows are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from marginlens.llm.common import map_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 1 << 16

# Unicode's White_Space property (fixed values).
_SPACE = r"\t-\r \x85\xa0  -     　"
# Ranges that hold letters only (fixed values).
_LETTER = r"A-Za-zÀ-ÖØ-öø-ɏЀ-ҁؠ-يぁ-ゖァ-ヺ一-鿿가-힣"
_RUN = re.compile(f"[{_SPACE}]{{256,}}")
_CUT = re.compile(rf"[{_LETTER}](?=[\x00-\x40])")


class Codec:
    def __init__(self, ranks_path: str, pattern: str = public_tokenizers.PATTERN):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        parts = [
            np.array((self.whole if single else self.words).encode_ordinary(t), np.uint32) for t, single in pieces(text)
        ]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids) -> bytes:
        return self.words.decode_bytes(ids)


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """(part, is one match of the pattern): parts that encode on their own as
    they do within the text."""
    at = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        end -= end < len(text)
        if at < start:
            yield from ((x, False) for x in _cuts(text[at:start]))
        yield text[start:end], True
        at = end
    if at < len(text):
        yield from ((x, False) for x in _cuts(text[at:]))


def _cuts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONG:
        cut = _CUT.search(text, at + LONG)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


def _encoded(batch: pa.RecordBatch, path: str, want_ids: bool) -> Iterator[pa.RecordBatch]:
    own, rows, n, ids_sha, text_sha = codec(path), [], [], [], []
    for text in batch.column("text").to_pylist():
        ids = own.encode(text)
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
        text_sha.append(hashlib.sha256(own.decode(ids.tolist())).hexdigest())
        if want_ids:
            rows.append(ids.astype(np.int32))
    cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if want_ids:
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        cols.append(pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), flat))
        names.append("ids")
    yield pa.RecordBatch.from_arrays(cols, names)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids array<int>): encodes
    every row's whole text and decodes the ids again, in one pass."""
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), lambda b: _encoded(b, path, True), f"doc_id {kind}, {_DIGESTS}, ids array<int>")


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """As ``encoded``, without the ids."""
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), lambda b: _encoded(b, path, False), f"doc_id {kind}, {_DIGESTS}")


def decoded(tokens: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, data binary): the raw bytes of every row's ids (null: none)."""
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batch):
        data = [codec(path).decode(x or []) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return map_batches(tokens.select("doc_id", "ids"), run, f"doc_id {kind}, data binary")
