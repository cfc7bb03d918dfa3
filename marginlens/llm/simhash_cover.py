"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles. Two fingerprints link when they differ in at most ``radius`` bits.

Candidate search is exact. Give every bit i a vector v(i) over GF(2) of
radius + 1 dimensions; the table of a non-zero vector a compares only the
bits with <a, v(i)> = 1. Any ``radius`` differing bits leave a common
orthogonal a, so every linked pair agrees on all compared bits of at least
one of the 2^(radius+1) - 1 tables, which each compare about half of the bits.

Equal fingerprints are one row before the search. A bucket of more than
``max_bucket`` fingerprints is covered again over the bits its table left
free: every level halves the free bits, so after three levels a bucket holds
at most 2^8 different fingerprints. Work in a bucket emits a spanning forest
of its links, not all pairs.

Null text counts as empty; a text without words has fingerprint zero. A null
doc_id gets a fingerprint and a component like any other row, but is never
the smallest id of a component: a component of null ids only has a null
component_id. Repeated rows are kept.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import map_batches, saved
from marginlens.llm.components import connected_components

SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII spaces
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return _majority(np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64))
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops]
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(flat[i : j - 1], SEED) for i, j in zip(starts, stops[shingle - 1 :])], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def masks(free: list[int], radius: int) -> list[int]:
    """The masks that cover all differences of up to ``radius`` bits among ``free``."""
    top = 1 << (radius + 1)
    # Vectors with the last dimension set come first: then each mask keeps
    # about half of few bits too.
    order = [*range(top // 2, top), *range(1, top // 2)]
    vector = [order[i % len(order)] for i in range(len(free))]
    out = {sum(1 << bit for bit, v in zip(free, vector) if (a & v).bit_count() % 2) for a in range(1, top)}
    return sorted(out)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(fps: DataFrame, radius: int, max_bucket: int = 4096) -> DataFrame:
    """(a, b): links that connect exactly what all pairs of different rows of
    ``fps`` (fp) within ``radius`` bits connect."""
    spark = fps.sparkSession
    members = fps.select("fp")
    tables = [0]  # the bits already compared
    found: DataFrame | None = None
    while True:
        finer = [sorted({t | m for m in masks([i for i in range(BITS) if not t >> i & 1], radius)}) for t in tables]
        if len(finer) == 1:
            each = F.array(*[F.lit(_signed(m)) for m in finer[0]])
            rows = members.select("fp", F.explode(each).alias("mask"))
        else:
            of = spark.createDataFrame([(_signed(t), [_signed(m) for m in f]) for t, f in zip(tables, finer)], "mask long, finer array<long>")
            rows = members.join(F.broadcast(of), "mask").select("fp", F.explode("finer").alias("mask")).distinct()
        rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        grouped = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sizes = saved(grouped.where("n > 1"), "simhash-buckets")
        pairs = sizes.where((F.col("n") == 2) & (_distance("a", "b") <= radius)).select("a", "b")
        several = rows.join(sizes.where((F.col("n") > 2) & (F.col("n") <= max_bucket)).select("mask", "key"), ["mask", "key"])
        lists = several.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        new = pairs.union(_forests(lists, radius))
        found = new if found is None else found.union(new)
        large = sizes.where(F.col("n") > max_bucket).select("mask", "key")
        if large.isEmpty():
            break
        members = saved(rows.join(large, ["mask", "key"]).select("fp", "mask"), "simhash-large")
        tables = [int(r["mask"]) % (1 << BITS) for r in large.select("mask").distinct().collect()]
    return found.distinct()


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _forests(lists: DataFrame, radius: int) -> DataFrame:
    def run(batch):
        out = [forest(np.array(x, np.int64).view(np.uint64), radius) for x in batch.column("fps").to_pylist()]
        ends = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        ends = ends.reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return map_batches(lists, run, "a long, b long")


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest, as (n, 2), of the links among different fingerprints."""
    rest = np.sort(fps)
    edges = []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                new = rest[near]
                edges.append(np.stack([np.full(len(new), at, np.uint64), new], 1))
                queue.extend(new)
                rest = rest[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)


def near_duplicates(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(doc_id, fingerprint, component_id, root) for every row of ``docs``;
    root names the component also where all its ids are null."""
    of = saved(fingerprints(docs, shingle), "simhash-fingerprints")
    least = saved(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(least.select("fp"), radius))
    linked = least.join(roots, least.fp == roots.node).select("fp", "root", "least")
    ids = saved(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    named = saved(roots.join(ids, "root").select(F.col("node").alias("fp"), "root", "component_id"), "simhash-named")
    alone = least.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    every = saved(named.unionByName(alone), "simhash-every")
    hex_fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return of.join(every, "fp").select("doc_id", hex_fp.alias("fingerprint"), "component_id", F.col("root"))


def keep_one(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """One row of each component, columns as they are: the row with the
    smallest id; of repeated rows with that id in the component, one. An id on
    rows of different components stays with each it names. A component of null ids
    only keeps all its rows of one fingerprint's root as a single row."""
    of = saved(near_duplicates(docs, shingle, radius), "simhash-kept")
    own = F.udf(lambda t: f"{fingerprint(t, shingle):016x}", "string", useArrow=True)
    first = of.where(F.col("doc_id") == F.col("component_id")).groupBy("root", "doc_id").agg(F.min("fingerprint").alias("__fp"))
    # Only rows whose id stands on several fingerprints are fingerprinted again.
    unlike = of.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("doc_id")
    if unlike.isEmpty():
        kept = docs.join(first.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        unlike = saved(unlike, "simhash-unlike")
        alike = first.join(unlike, "doc_id", "left_anti").select("doc_id")
        kept = docs.join(alike, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        several = docs.join(unlike, "doc_id", "left_semi").withColumn("__fp", own("text")).join(first, ["doc_id", "__fp"], "left_semi")
        kept = kept.unionByName(several.dropDuplicates(["doc_id", "__fp"]).drop("__fp"))
    if of.where(F.col("component_id").isNull()).isEmpty():
        return kept
    # Rows without id: one of each component that has no id at all.
    lone = of.where(F.col("component_id").isNull()).groupBy("root").agg(F.min("fingerprint").alias("__fp")).select("__fp")
    marked = docs.where(F.col("doc_id").isNull()).withColumn("__fp", own("text")).join(lone, "__fp", "left_semi")
    return kept.unionByName(marked.dropDuplicates(["__fp"]).drop("__fp"))
