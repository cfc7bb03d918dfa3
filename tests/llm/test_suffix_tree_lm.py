"""The automaton against longest-suffix lookups, the base score against its
definition, probabilities against one."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginlens.llm import entry, suffix_tree_lm as lm
from marginlens.llm.common import learned

SF = "/root/testdata/sf0.001"
TEXTS = ["The cat sat on the mat.", "the dog sat\non the log", "a cat and a dog", "", None, "été déjà été", "the the the the"] * 4


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    counts = lm.counts(docs, 4).where("code IS NOT NULL").select("code", "n")
    root, nodes, tail = lm.head_and_tail(lm.states(counts, 4, 1), 1000)
    assert tail.count() == 0
    return counts, root, nodes, lm.build(root, nodes, 4, 1e-3, 2.0)


def test_gram_counts_are_whole(fitted):
    counts, *_ = fitted
    want = Counter()
    for t in TEXTS:
        data = b"\n" * 4 + b" ".join(lm.words_of(t)) + b"\n"
        for i in range(4, len(data)):
            want[int.from_bytes(data[i - 4 : i + 1], "big")] += 1
    assert {r["code"]: r["n"] for r in counts.collect()} == want


def by_hand(tree_nodes, root, text, depth, least, smooth):
    """Scores by looking up the longest retained suffix at every place."""
    count = np.zeros(256)
    for s, n in root:
        count[s] = n
    common = (count >= max(1, least * count.sum())) | (np.arange(256) == lm.END)
    kind = np.where(common, np.arange(256), 256)
    size = np.bincount(kind, count + 1, 257)

    def dist(context):
        if not context:
            return size / size.sum()
        shorter = context[1:]
        while shorter and (len(shorter), int.from_bytes(shorter, "big")) not in tree_nodes:
            shorter = shorter[1:]
        n = np.zeros(257)
        for s, c in tree_nodes[len(context), int.from_bytes(context, "big")]:
            n[kind[s]] += c
        return (n + smooth * dist(shorter)) / (n.sum() + smooth)

    data = b"\n" * depth + text + b"\n"
    total = 0.0
    for i in range(depth, len(data)):
        context = data[i - depth : i]
        while context and (len(context), int.from_bytes(context, "big")) not in tree_nodes:
            context = context[1:]
        p = dist(context)
        assert abs(p.sum() - 1) < 1e-9
        total += math.log10(p[kind[data[i]]] * (count[data[i]] + 1) / size[kind[data[i]]])
    return total


def test_automaton_finds_the_longest_suffix(fitted):
    _, root, nodes, tree = fitted
    assert any(k == 4 for k, _ in nodes) and any(k == 1 for k, _ in nodes)
    for text in (b"the cat sat", b"", b"zq\xc3\xa9t\xc3\xa9 \x00the dog", b"the the the log" * 50):
        words = text.split()
        data, real, _ = lm.stream([words], 4)
        for strips, block in ((8192, 1 << 22), (3, 50)):
            got = tree.scores(data, strips, block)[real].sum()
            assert got == pytest.approx(by_hand(nodes, root, b" ".join(words), 4, 1e-3, 2.0), rel=1e-5)


def by_divergence(texts, depth, least):
    """Contexts by the definition: counted, tested against the suffix, closed."""
    n = {}
    for t in texts:
        data = b"\n" * depth + b" ".join(lm.words_of(t)) + b"\n"
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                n.setdefault(data[i - k : i], Counter())[data[i]] += 1
    total = n[b""].total()
    stay = set()
    for ctx, own in n.items():
        if ctx and own.total() >= least:
            up = n[ctx[1:]]
            gain = sum(c * math.log(c * up.total() / (own.total() * up[s])) for s, c in own.items())
            if gain > len(own) * 0.5 * math.log(total):
                stay |= {ctx[i:] for i in range(len(ctx))}
    return {(len(c), int.from_bytes(c, "big")): sorted(n[c].items()) for c in stay}


@pytest.mark.parametrize("least", [1, 6, 40])
def test_contexts_stay_by_the_divergence_test(spark, fitted, least):
    found = lm.states(fitted[0], 4, least)
    _, nodes, _ = lm.head_and_tail(found, 10_000)
    assert nodes == by_divergence(TEXTS, 4, least)
    assert found.where("k = 0").count() == 1


def test_head_size_changes_no_score(spark, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS + ["zq the dog sat on été", "q" * 3000, "the cat sat on a log " * 500])])
    want = None
    for head in (10_000, 40, 5, 1, 0):
        rows = lm.scores(docs, F.col("doc_id") % 5 != 0, depth=4, least=3, head=head, smooth=2.0).collect()
        got = {r["doc_id"]: r["score"] for r in rows}
        want = want or got
        assert len(rows) == len(got) == len(want)
        assert got == pytest.approx(want, rel=1e-6)


def test_every_tail_context_is_in_the_filter(fitted):
    found = lm.states(fitted[0], 4, 1)
    _, nodes, tail = lm.head_and_tail(found, 30)
    held, opened = lm.tail_filter(tail)
    own = {(r["k"], r["ctx"]) for r in tail.collect()}
    front = [(k, c) for k, c in own if (k - 1, c & ((1 << 8 * (k - 1)) - 1)) not in own]
    assert front and len(nodes) == 30
    assert opened == {(k - 1, c & ((1 << 8 * (k - 1)) - 1)) for k, c in front} and opened - {(0, 0)} <= set(nodes)
    for bit in lm.bits_of(np.array([c for _, c in front]), np.array([k for k, _ in front])):
        assert ((held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).all()


def test_contexts_grow_with_the_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = []
    for part in (docs.where("doc_id % 4 = 0"), docs):
        found = lm.counts(part, 6).where("code IS NOT NULL").select("code", "n")
        kept.append({(r["k"], r["ctx"]) for r in lm.states(found, 6, 50).select("k", "ctx").collect()})
    assert len(kept[1]) > 1.5 * len(kept[0])


def test_base_score_of_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {}
    for i, t in docs.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        tokens[i] = re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]
    c = Counter(w for i, own in tokens.items() if not out(i) for w in own)
    n, v = sum(c.values()), len(c)
    for frequent in (2e-6, 0.01):
        rows = lm.scores(spark.read.parquet(f"{SF}/documents.parquet"), learned(F.col("doc_id"), 7, 2), frequent=frequent).collect()
        assert len(rows) == len(docs)
        for r in rows:
            own = tokens[r["doc_id"]]
            assert r["n_tokens"] == len(own) and r["train_tokens"] == n
            assert r["n_known"] == sum(c[w] > 0 for w in own)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
            assert r["score"] < 0
    got = entry.op4_lm_score(spark, SF).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == out(r["doc_id"]) for r in got)


def test_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (1, None), (2, ""), (None, "a b"), (3, "a b c"), (5, "x" * 50_000)]).selectExpr("*", "1 as score", "2 as row", "3 as word")
    rows = lm.scores(docs, learned(F.col("doc_id"), 7, 2)).collect()
    assert len(rows) == 6
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 2, 3, 4]
    empty = lm.scores(docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in empty} == {(0, 0)}
    assert [r["base_score"] for r in empty] == [0.0] * 6
    assert lm.scores(docs.limit(0), F.lit(True)).count() == 0
