"""Fingerprints by the definition, links and components by brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from marginlens.llm import entry, simhash_cover
from marginlens.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def by_definition(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    """{fp: smallest fp of its component}."""
    fps = np.unique(np.array(sorted(fps), np.uint64))
    seen, out = np.zeros(len(fps), bool), {}
    for i in range(len(fps)):
        if seen[i]:
            continue
        todo, seen[i], group = [i], True, []
        while todo:
            j = todo.pop()
            group.append(j)
            new = np.flatnonzero((np.bitwise_count(fps ^ fps[j]) <= radius) & ~seen)
            seen[new] = True
            todo += new.tolist()
        for j in group:
            out[int(fps[j])] = int(fps[min(group)])
    return out


@pytest.mark.parametrize("n", [64, 32, 31, 16, 15, 9, 4, 1])
def test_masks_cover_every_difference(n):
    rng = random.Random(n)
    free = sorted(rng.sample(range(64), n))
    masks = simhash_cover.masks(free, 4)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(free, min(4, n)))
        assert any(not m & differ for m in masks)
    assert all(m.bit_count() <= max(1, n) for m in masks)


def test_fingerprints_and_components_of_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.op5_simhash(spark, SF).collect()
    assert len(rows) == len(docs)
    own = {i: by_definition(t) for i, t in docs.items()}
    root = brute_components(own.values(), 4)
    least = {}
    for i, fp in own.items():
        least[root[fp]] = min(i, least.get(root[fp], i))
    for r in rows:
        assert r["fingerprint"] == f"{own[r['doc_id']]:016x}"
        assert r["component_id"] == least[root[own[r["doc_id"]]]]


def test_large_buckets_are_split_exactly(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    table = spark.createDataFrame(signed, "fp long")
    want = brute_components(fps, 4)
    for most in (4096, 20):
        got = connected_components(simhash_cover.links(table, 4, max_bucket=most)).collect()
        groups = {}
        for r in got:
            groups.setdefault(r["root"], set()).add(r["node"] % 2**64)
        expected = {}
        for f, r in want.items():
            expected.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_null_empty_repeated_and_extra_columns(spark, make_docs):
    docs = make_docs([(3, None), (2, ""), (2, ""), (None, " \n"), (None, "only here now"), (9, "a b c d e f"), (8, "a b c d e f")])
    docs = docs.selectExpr("*", "'x' as fingerprint", "1 as component_id", "2 as fp", "3 as root")
    rows = simhash_cover.near_duplicates(docs, 4, 4).collect()
    assert len(rows) == 7
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert [r["component_id"] for r in rows if r["doc_id"] in (8, 9)] == [8, 8]
    kept = simhash_cover.keep_one(docs, 4, 4)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "only here now"), (2, ""), (8, "a b c d e f")]
    assert simhash_cover.near_duplicates(docs.limit(0), 4, 4).count() == 0
    assert simhash_cover.keep_one(docs.limit(0), 4, 4).count() == 0


def test_one_id_on_unlike_texts_keeps_each(spark, make_docs):
    a, b = "a b c d e f g h", "quite another text of other words altogether, and long enough"
    docs = make_docs([(1, a), (1, b), (1, a), (2, b), (3, "the third text has nothing in common with them")])
    kept = sorted((r["doc_id"], r["text"]) for r in simhash_cover.keep_one(docs, 4, 4).collect())
    assert kept == [(1, a), (1, b), (3, "the third text has nothing in common with them")]
