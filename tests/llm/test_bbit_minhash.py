"""Components against all pairs on real sets of shingle texts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginlens.llm import bbit_minhash, entry

SF = "/root/testdata/sf0.01"


def sets_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def by_definition(rows):
    """(doc_id, n, component) of (doc_id, text), every pair that shares a shingle compared."""
    sets = [sets_by_definition(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    of = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in of[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = entry.op13_minhash(spark, SF)
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    assert got(df) == by_definition(rows)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_chains_hubs_and_pairs_near_the_limit(spark, make_docs):
    """Groups around the limit: near copies of a base, chains of edits, and
    texts that share buckets but are not similar, dealt over several slices."""
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"w{group}x{i}" for i in range(60)]
        rows += [edited(rng, base, rng.randrange(0, 5)) for _ in range(40)]
        chain = base
        for _ in range(10):
            chain = edited(rng, chain, 1).split()
            rows.append(" ".join(chain))
    rows += [f"alone {i} of its own kind number {i * i}" for i in range(30)]
    docs = list(enumerate(rows))
    rng.shuffle(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(bbit_minhash.near_duplicates(make_docs(docs))) == by_definition(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("few", [300, 1 << 17])
def test_copies_just_under_the_limit_are_compared_in_blocks(spark, make_docs, monkeypatch, few):
    """A large group with about half of its pairs under the limit, some linked
    only through others: many pairs of blocks, and a single block."""
    monkeypatch.setattr(bbit_minhash, "FEW", few)
    seen = []
    real = bbit_minhash._open_links
    monkeypatch.setattr(bbit_minhash, "_open_links", lambda *a: seen.append(1) or real(*a))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, edited(rng, base, rng.choice((1, 3, 4, 5, 6, 7)))) for i in range(150)]
    docs += [(i + 1000, edited(rng, [f"v{i}" for i in range(50)], 3)) for i in range(40)]
    want = by_definition(docs)
    assert got(bbit_minhash.near_duplicates(make_docs(docs))) == want
    assert seen and 20 < len({c for _, _, c in want}) < 180


def test_estimates_are_those_of_the_columns(spark):
    rng = np.random.default_rng(3)
    sigs = rng.integers(-(2**63), 2**63, (50, bbit_minhash.HASHES // bbit_minhash.LANES), np.int64)
    sigs[1:25] ^= sigs[1:25] & sigs[25:49]
    df = spark.createDataFrame([(r.tolist(), sigs[0].tolist()) for r in sigs], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(bbit_minhash.estimate("a", "b")).collect()]
    assert np.allclose(got, bbit_minhash.estimates(sigs.view(np.uint64), sigs[0].view(np.uint64)))


def test_nulls_empty_short_repeats_and_clashing_columns(spark, make_docs):
    long = " ".join(f"t{i % 997}" for i in range(40_000))
    docs = [(4, None), (3, ""), (3, ""), (2, " \n\t"), (None, None), (None, "one text without id"), (None, "one text without id")]
    docs += [(9, "Two Words"), (8, "two  words"), (7, "two words more"), (11, long), (10, long + " end"), (12, "two words"), (12, "unlike text of this id here")]
    table = make_docs(docs).selectExpr("*", "1 as id", "2 as n", "3 as part", "4 as bucket", "5 as set_key", "6 as __slice", "7 as kept")
    assert got(bbit_minhash.near_duplicates(table)) == by_definition(docs)
    assert bbit_minhash.near_duplicates(table.limit(0)).count() == 0
    assert bbit_minhash.near_duplicates(table.where("doc_id = 3")).count() == 2


def test_shingles_over_stretches_and_long_words():
    rng = random.Random(2)
    for n in (1, 3, 4, 5, 300, 16_383, 16_384, 16_390, 40_000):
        text = " ".join(rng.choice(["A", "b", "é", "\0", "x" * 300, "x" * 301, str(rng.randrange(9999))]) for _ in range(n))
        assert len(bbit_minhash.shingles(text, 4)) == len(sets_by_definition(text))
        assert set(bbit_minhash.shingles(f"head of it {text}", 4)) >= set(bbit_minhash.shingles(text, 4)) or n < 4


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_estimate_is_corrected_for_chance(spark, share):
    rng = np.random.default_rng(1)
    errors = []
    rows = []
    for _ in range(60):
        common = rng.integers(0, 2**63, int(400 * share), np.uint64)
        own = [rng.integers(0, 2**63, (400 - len(common)) // 2, np.uint64) for _ in range(2)]
        rows.append([bbit_minhash.packed(bbit_minhash.minima(np.concatenate([common, x]))).tolist() for x in own])
        errors.append(len(common) / (len(common) + 2 * len(own[0])))
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(bbit_minhash.estimate("a", "b")).collect()]
    assert abs(float(np.mean(got)) - float(np.mean(errors))) < 0.02
    assert max(abs(g - e) for g, e in zip(got, errors)) < 0.2
