"""Roots, witnesses and tampering against a plain level-by-level tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marginlens.llm import entry, merkle_manifest

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels, and for each node at the bottom its siblings upwards as (side, digest)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append((None, None) if other >= len(nodes) else ("L" if other < p else "R", nodes[other]))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return (nodes[0] if nodes else None), paths


def by_definition(rows):
    """{(doc_id, leaf): [expected rows]} of (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in langs}
    trees = {g: tree([leaf_of(r) for r in of]) for g, of in ordered.items()}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for r, path in zip(ordered[g], trees[g][1]):
            full = path + top
            claim = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                claim = (*r[:3], r[3] + 1, r[4])
            at = leaf_of(claim)
            for side, sib in full:
                at = H(at) if side is None else H(sib, at) if side == "L" else H(at, sib)
            out.append((r[0], leaf_of(r), trees[g][0], root, H(*[s for side, s in full if side]), at, at == root))
    return sorted(out, key=repr)


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(FIELDS).collect()]
    found = got(entry.op12_merkle(spark, SF))
    assert found == by_definition(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_small_blocks_at_every_size(spark, bits):
    """Blocks of 2, 4 and 8 leaves, so several levels of block roots; groups of 1 to 23 leaves."""
    rows = [(i * 7 % 101, "s", f"g{n:02d}", i, f"text {n} {i}") for n in range(1, 24) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = entry.merkle_rows(docs, bits=bits)
    assert got(out) == by_definition(rows)


def test_append_block_equals_the_tree():
    for n in range(1, 40):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        witness, root, _ = merkle_manifest.append_block(leaves, 0, 6)
        want, _ = tree([d.hex() for d in leaves])
        assert root.hex() == want
        assert all(merkle_manifest.fold(d, w) == root for d, w in zip(leaves, witness))


def test_nulls_ties_repeats_empty_and_clashing_columns(spark):
    rows = [
        (None, None, None, None, None),
        (None, None, None, None, None),
        (5, "s", None, 0, ""),
        (5, "s", None, 0, ""),
        (5, "s", None, 3, "two"),
        (8, "s", "", 9223372036854775807, "empty language"),
        (9, "", "é", -4, "x" * 200_000),
        (28, "s", "z", None, "tampered where nothing can be added"),
        (-3, "s", "z", 1, "negative"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = docs.selectExpr("*", "1 as leaf", "2 as hash", "3 as pos", "4 as grp", "5 as root", "6 as witness", "7 as __block", "8 as lift")
    assert got(entry.merkle_rows(clash)) == by_definition(rows)
    assert entry.merkle_rows(docs.limit(0)).count() == 0
    one = docs.where(F.col("doc_id") == 9)
    (row,) = entry.merkle_rows(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == H("")
