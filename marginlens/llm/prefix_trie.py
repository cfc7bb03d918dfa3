"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Turns are ranked within their conversation over range slices (a conversation of
any length lies in several tasks). A prefix is named by its depth and the XOR
of two 64-bit hashes of (position, SHA-256 of role and text) over its turns, so
names come from a running fold and texts are read once and never shuffled. A
trie node is a group of equal names; its parent's name is its own without the
last turn's hashes.

Nodes are numbered along (parent's name, own name), so siblings are neighbours.
Each node has an enter and an exit arc: enter leads to the first child's enter,
or to the own exit; exit leads to the next sibling's enter, or to the parent's
exit. ``list_rank`` gives every arc its place in the tour, and running sums along
the tour, dealt by place, give a subtree's sums as the difference between its
two arcs. No window, join or group holds all children of a node: the children
of one parent are counted with partial sums, and a parent's columns meet its
children slice by slice.

Null role or text counts as empty. Turns order by number, null first; turns of
one number by role, then the digest of role and text; repeated rows are turns
of their own. Rows without conv_id belong to no conversation and are left out.
Without conversations there is no node, also no root. Columns not named are
not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.slices import AT, SLICE, running, sliced
from marginlens.llm import list_rank
from marginlens.llm.common import saved

#: A conversation begins with up to HEADS - 1 turns of the first one of its hundred.
HEADS, EVERY = 6, 100
NAME = ["depth", "p_a", "p_b"]  # of a node
PARENT = ["q_depth", "q_a", "q_b"]


def _long(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx from 0, a, b, size): a and b are 128 bits of the turn's digest, size its code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("size")
    )
    rows = rows.select("conv_id", "turn", "role", _long(F.col("digest"), 1).alias("a"), _long(F.col("digest"), 17).alias("b"), "size")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("a").asc(), F.col("b").asc()]
    cut = sliced(saved(rows, "trie-turns"), ["conv_id"], order, lambda df: saved(df, "trie-slices"))
    counted = running(cut, ["conv_id"], {"n": ("sum", F.lit(1))})
    return saved(counted.select("conv_id", SLICE, (F.col("n") - 1).alias("idx"), "a", "b", "size"), "trie-numbered")


def _borrowed_turns() -> Column:
    return F.crc32(F.col("conv_id").cast("string")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, slice, depth from 1, a, b, size, last) and
    the conversations (conv_id, size in turns)."""
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    heads = turns.where((F.col("conv_id") % EVERY == 0) & (F.col("idx") < HEADS - 1)).select(F.col("conv_id").alias("base"), "idx", "a", "b", "size")
    offered = heads.groupBy("base").agg(F.count("*").alias("offered"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", _borrowed_turns()).withColumn("base", base)
    convs = convs.join(offered, "base", "left").withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "taken", F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"))
    convs = saved(convs, "trie-convs")
    total = F.col("taken") + F.col("kept")
    first = convs.where("taken > 0").join(heads, "base").where("idx < taken")
    first = first.select("conv_id", F.lit(-1).cast("int").alias(SLICE), (F.col("idx") + 1).alias("depth"), "a", "b", "size", total.alias("total"))
    # A long conversation meets its own row slice by slice.
    spans = turns.select("conv_id", SLICE).distinct().join(convs, "conv_id")
    own = turns.join(spans, ["conv_id", SLICE]).where("idx >= h")
    own = own.select("conv_id", F.col(SLICE).cast("int").alias(SLICE), (F.col("idx") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "size", total.alias("total"))
    steps = first.unionByName(own).withColumn("last", F.col("depth") == F.col("total")).drop("total")
    return steps, convs.select("conv_id", total.alias("total"))


def _named(steps: DataFrame) -> DataFrame:
    """Every rebuilt turn with the names of the prefix it ends and of the one before it."""
    keyed = steps.select(
        "conv_id", SLICE, "depth", "size", "last", F.xxhash64("depth", "a", "b").alias("s_a"), F.xxhash64("b", "a", -F.col("depth")).alias("s_b")
    )
    folds = {"p_a": ("xor", F.col("s_a")), "p_b": ("xor", F.col("s_b"))}
    named = running(saved(keyed, "trie-steps"), ["conv_id"], folds, order="depth")
    named = named.withColumn("q_a", F.col("p_a").bitwiseXOR(F.col("s_a"))).withColumn("q_b", F.col("p_b").bitwiseXOR(F.col("s_b")))
    return saved(named.drop(SLICE, "s_a", "s_b"), "trie-paths")


def _sha_of_ends(ends: DataFrame) -> DataFrame:
    """NAME and the SHA-256 of the group's conv_ids, ascending, comma-joined. A
    slice joins its part of a group into one text; the parts of a group then
    stream through one digest in order, never gathered."""
    cut = sliced(ends.select(*NAME, "conv_id"), NAME, [F.col("conv_id").asc()], lambda df: saved(df, "trie-ends"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = cut.groupBy(*NAME, SLICE).agg(joined.alias("ids"))
    ordered = parts.repartition(*NAME).sortWithinPartitions(*NAME, SLICE)

    def run(batches):
        name, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*NAME, "ids")]):
                if own == name:
                    digest.update(b"," + ids.encode())
                    continue
                if name is not None:
                    out.append((*name, digest.hexdigest()))
                name, digest = own, hashlib.sha256(ids.encode())
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        if name is not None:
            out.append((*name, digest.hexdigest()))
        if out:
            yield _rows(out)

    def _rows(out):
        *longs, text = zip(*out)
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array(text)], [*NAME, "ends_sha256"])

    return ordered.select(*NAME, "ids").mapInArrow(run, "depth long, p_a long, p_b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    steps, convs = rebuilt(numbered_turns(conversations))
    paths = _named(steps)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("p_a"), zero.alias("p_b"), zero.alias("q_a"), zero.alias("q_b"), "n_convs", "conv_id", zero.alias("size"))
    below = paths.groupBy(*NAME).agg(
        F.max("q_a").alias("q_a"), F.max("q_b").alias("q_b"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size")
    )
    nodes = saved(below.unionByName(root).withColumn("q_depth", F.col("depth") - 1), "trie-nodes")
    cut = sliced(nodes, PARENT, [F.col("p_a").asc(), F.col("p_b").asc()], lambda df: saved(df, "trie-order"))
    # One order over all nodes: the number is a node's place along (parent, own name).
    tree = saved(running(cut, [], {"id": ("sum", F.lit(1))}).drop(AT), "trie-numbers")
    tree = tree.withColumn("id", F.col("id") - 1)
    of = tree.where("depth > 0").groupBy(F.col("q_depth").alias("depth"), F.col("q_a").alias("p_a"), F.col("q_b").alias("p_b"))
    families = of.agg(F.min("id").alias("first"), F.max("id").alias("final"), F.count("*").alias("n_children"))
    family = saved(tree.join(families, NAME, "left"), "trie-families")

    sums = saved(_subtree_sums(family), "trie-sums")
    ends = paths.where("last").select(*NAME, "conv_id").unionByName(convs.where("total = 0").select(zero.alias("depth"), zero.alias("p_a"), zero.alias("p_b"), "conv_id"))
    # A parent meets its children slice by slice, however many they are.
    spans = tree.where("depth > 0").select(SLICE, *PARENT).distinct()
    parents = tree.select(*[F.col(n).alias(q) for n, q in zip(NAME, PARENT)], F.col("conv_id").alias("parent_conv_id"))
    parents = spans.join(parents, PARENT)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        family.join(parents, [SLICE, *PARENT], "left")
        .join(sums, "id")
        .join(_sha_of_ends(ends), NAME, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )


def _subtree_sums(family: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens) over the subtree of each node."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    leaf = F.col("first").isNull()

    def arc(a: Column, b: Column) -> Column:
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    down = F.array(arc(enter, F.when(leaf, leave).otherwise(F.col("first") * 2)))
    up = F.when(~leaf, F.array(arc(F.col("final") * 2 + 1, leave))).otherwise(F.array().cast("array<struct<a:long,b:long>>"))
    end = F.when(F.col("depth") == 0, F.array(arc(leave, F.lit(None)))).otherwise(F.array().cast("array<struct<a:long,b:long>>"))
    arcs = family.select(F.explode(F.concat(down, up, end)).alias("arc")).select("arc.*")
    finals = family.where(~leaf).select(F.col("final").alias("id"))
    beside = family.where("depth > 0").select("id").join(finals, "id", "left_anti").select(leave.alias("a"), (leave + 1).alias("b"))
    links = saved(arcs.unionByName(beside), "trie-arcs")
    length = links.count()
    # Dealt by place in the tour: as many equal parts as the shuffle has partitions.
    part = max(1, -(-length // int(family.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = list_rank.ranks(links).select(F.shiftright("a", 1).alias("id"), (F.col("a") % 2 == 0).alias("enters"), (F.lit(length - 1) - F.col("rank")).alias(AT))
    own = family.select("id", leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("tokens"))
    tour = placed.join(own, "id").withColumn(SLICE, (F.col(AT) / part).cast("long"))
    at_enter = lambda c: F.when(F.col("enters"), F.col(c)).otherwise(0)
    tour = saved(tour, "trie-tour")
    along = running(tour, [], {"to_leaves": ("sum", at_enter("leaves")), "to_tokens": ("sum", at_enter("tokens"))})

    def inside(total: str, own: str) -> Column:
        return F.sum(F.when(F.col("enters"), F.col(own) - F.col(total)).otherwise(F.col(total)))

    return along.groupBy("id").agg(inside("to_leaves", "leaves").alias("n_leaves"), inside("to_tokens", "tokens").alias("saved_tokens"))
