"""The trie against one built from nested dictionaries; list ranking against a walk."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from marginlens.llm import entry, list_rank, prefix_trie

SF = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_definition(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d:
                nodes[tuple(path[: d - 1])]["children"].add(tuple(path[:d]))
        nodes[tuple(path)]["ends"].append(c)

    out, sums = [], {}
    for key in sorted(nodes, key=len, reverse=True):
        n = nodes[key]
        saved = (len(n["members"]) - 1) * (len(key[-1][1]) if key else 0)
        leaves = 0 if n["children"] else 1
        sums[key] = (leaves + sum(sums[k][0] for k in n["children"]), saved + sum(sums[k][1] for k in n["children"]))
        sha = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        parent = min(nodes[key[:-1]]["members"]) if key else None
        out.append((min(n["members"]), len(key), parent, len(n["members"]), len(n["children"]), *sums[key], sha))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = entry.op11_prefix_trie(spark, SF)
    assert got(df) == by_definition(rows)
    assert all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")


def test_copies_long_and_cut_conversations(spark):
    """Copies, one conversation of 700 turns, shared first turns, absent bases, negative ids; dealt over several slices."""
    rng = random.Random(7)
    rows = [(12, i, "user", f"turn {i}") for i in range(700)]
    for c in [*range(0, 130), 305, 306, -5, -250, 1000]:
        if c == 12:
            continue
        kind = c % 4
        n = rng.randrange(0, 7) if kind else 3
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"same {i}" if kind < 2 else f"own {rng.randrange(3)} {i}") for i in range(max(n, 1))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(prefix_trie.trie(spark.createDataFrame(rows, TURN))) == by_definition(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nulls_ties_repeats_empty_and_clashing_columns(spark):
    rows = [
        (7, None, None, None),
        (7, None, "", ""),
        (7, 0, "user", "é" * 50_000),
        (7, 0, "user", "é" * 50_000),
        (8, 1, None, "x"),
        (8, None, "a", None),
        (None, 3, "user", "of no conversation"),
        (0, 5, "user", "base"),
        (0, 2, "user", ""),
        (100, 1, "user", "b"),
    ]
    turns = spark.createDataFrame(rows, TURN)
    clash = turns.selectExpr("*", "1 as depth", "2 as p_a", "3 as id", "4 as n", "5 as __slice", "6 as idx", "7 as base")
    assert got(prefix_trie.trie(clash)) == by_definition(rows)
    assert prefix_trie.trie(turns.limit(0)).count() == 0


@pytest.mark.parametrize("n, spread, short", [(1, 4, 1), (2, 4, 1), (900, 4, 10), (900, 64, 1), (900, 4, 10_000)])
def test_list_ranking(spark, n, spread, short):
    order = list(range(n))
    random.Random(n).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], None])], "a long, b long")
    found = {r["a"]: r["rank"] for r in list_rank.ranks(links, spread, max(short, 1)).collect()}
    assert found == {a: n - 1 - i for i, a in enumerate(order)}
