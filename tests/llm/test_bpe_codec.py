"""Encoding is held against the library on whole texts, decoding against the
texts' own bytes."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marginlens.llm import bpe_codec, entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe_codec.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(public_tokenizers.path(bpe_codec.RANKS))


TEXTS = [
    "",
    " ",
    "a",
    "It's we'll they'd 123 4五六 x²3 don't\n\n  end \t ",
    "日本語の文章。次の文。" * 50,
    "emoji 👩‍👩‍👧‍👦 é é    x",
    "null\x00 control\x1c\x1d bytes",
    "word " * 30_000,
    "abc,def;ghi\n" * 20_000,
    "x" + " " * 300 + "y" + "\n" * 257 + "z" + "\t" * 500,
    " " * 400,
    "a²3 " * 30_000,
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_encodes_as_the_library_does(codec, library, i):
    text = TEXTS[i]
    ids = codec.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert codec.decode(ids.tolist()) == text.encode()


def test_random_texts_with_short_limit(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "LONG", 5)
    rng = random.Random(3)
    alphabet = "ab'sé²9五 \n\t.,ll 　"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert codec.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_very_long_runs_do_not_exhaust_the_matcher(codec):
    for text in (" " * 1_000_000 + "a", "\n" * 500_000, "ab" * 200_000, "1" * 300_000):
        assert codec.decode(codec.encode(text).tolist()) == text.encode()


def test_query_over_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in entry.op2_byte_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        ids = library.encode_ordinary(text)
        row = got[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_null_repeated_empty_and_extra_columns(spark, make_docs):
    docs = make_docs([(1, None), (1, None), (None, "a b"), (2, "")]).selectExpr("*", "1 as n_tokens", "'x' as ids")
    rows = bpe_codec.encoded(docs).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in rows) == [(False, 0), (False, 0), (False, 0), (True, 2)]
    back = bpe_codec.decoded(bpe_codec.encoded(docs)).collect()
    assert sorted(bytes(r["data"]) for r in back) == [b"", b"", b"", b"a b"]
    assert bpe_codec.encoded(docs.limit(0)).count() == 0
