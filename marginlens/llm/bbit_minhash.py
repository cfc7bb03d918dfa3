"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles. Of each of ``HASHES``
hash functions the minimum over the set is taken. Bands of ``ROWS`` whole
minima are bucket keys: a pair of Jaccard similarity 0.8 misses all 32 bands
with probability 3e-6. Of each minimum only the low ``LOW_BITS`` bits are
kept, 16 to a long; a candidate pair's equal lanes are counted by bit counts,
and the share, corrected for lanes that agree by chance, estimates the
similarity. Pairs estimated at least ``MARGIN`` below the limit (4.5 standard
deviations) go; the others are confirmed on both full sets.

Equal sets are one row from the start. Buckets aren't expanded to pairs: a
round compares all members of a bucket with a pivot, merges what is
confirmed, and drops the buckets whose members are one component by then. A
pivot has met its whole bucket and leaves it, and pairs within a component are
not compared, so a bucket of n near copies costs n pairs. Rounds go on, with
more pivots each, while a round settles half of the memberships before it.
What is left are copies just under the limit, for which every pair has to be
looked at: the texts whose open buckets are connected are dealt to blocks of a
bounded number of shingles, and each pair of blocks is compared in one task, by
signatures first and full sets then, which returns a spanning forest of the
links and no pairs. The result is that of all pairs. Members meet pivots, and
pairs their sets, slice by slice (see ``functions.slices``), so neither a large
bucket nor a pivot of many pairs is one task.

A document with fewer words than a shingle has one shingle, its whole words;
one without words (null or empty text) has none and links with nothing: its
component is its own id. Shingles are compared by 64-bit hashes (a word of over
256 bytes stands in them by its 128-bit digest). A null
doc_id is never the smallest id of a component; a component of null ids only
has a null component_id, and its rows are not kept. Repeated rows are kept as
they come; equal ids on unlike texts are judged each by its own text. Other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.slices import SLICE, sliced
from marginlens.llm.common import forget, map_batches, mark, saved
from marginlens.llm.components import connected_components

SHINGLE, SIMILAR = 4, 80  # words; percent
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
LOW_BITS = 4
LANES = 64 // LOW_BITS
MARGIN = 0.15
#: Shingles of a block: few, so that a group is many tasks, until it has
#: ``BLOCKS`` blocks; then as many as a task holds well, so that little is dealt twice.
FEW, MOST, BLOCKS = 1 << 17, 1 << 21, 8
#: Keys of texts that are sent to every task, 8 bytes each; beyond it the texts are joined.
MOST_KEYS = 1 << 22

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(0, 2**31, (HASHES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, (HASHES, 1), np.uint32)
_BAND = _rng.integers(0, 2**63, BANDS, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


_LONG_WORD, _STRETCH = 256, 1 << 14
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    if max(map(len, words)) > _LONG_WORD:
        words = [w if len(w) <= _LONG_WORD else b"\0" + xxhash.xxh3_128_hexdigest(w).encode() for w in words]
    parts = [_hashes(words[at : at + _STRETCH + size - 1], size) for at in range(0, max(len(words) - size + 1, 1), _STRETCH)]
    return np.unique(np.concatenate(parts))


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """All shingles of a stretch at once: differences of running polynomial
    sums over the bytes, brought to a common power and mixed."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    up, down = _powers(max(16, (len(flat) + 1).bit_length()))
    stops = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], stops[:-1] + 1])
    last = min(size, len(words)) - 1
    starts, stops = starts[: len(starts) - last], stops[last:]
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    x = (sums[stops] - sums[starts]) * down[starts]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The 32-bit minima, mixed so that their low bits are as good as any."""
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 512):  # 512 x 160 values stay in a core's cache
        values = _TIMES * high[None, at : at + 512]
        values += _PLUS
        np.minimum(out, values.min(1), out=out)
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return (out ^ (out >> np.uint32(13))).astype(np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _ODD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, ``LANES`` to a long."""
    lanes = (low & np.uint64((1 << LOW_BITS) - 1)).reshape(-1, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(LOW_BITS))
    return np.bitwise_or.reduce(lanes, 1).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: equal lanes by bit counts, less
    those that agree by chance (one in 2**LOW_BITS)."""
    ones = sum(1 << (LOW_BITS * i) for i in range(LANES))
    mask = F.lit(ones - (1 << 64) if ones >> 63 else ones)

    def unequal(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = reduce(lambda y, s: y.bitwiseOR(F.shiftrightunsigned(x, s)), range(1, LOW_BITS), x)
        return F.bit_count(any_bit.bitwiseAND(mask))

    equal = 1.0 - reduce(lambda x, y: x + y, [unequal(i) for i in range(HASHES // LANES)]) / HASHES
    chance = 2.0**-LOW_BITS
    return (equal - chance) / (1 - chance)


def estimates(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """``estimate`` of each of the signatures ``sigs`` with ``sig``."""
    x = sigs ^ sig
    for s in [1] * (LOW_BITS - 1):
        x = x | (x >> np.uint64(s))
    ones = np.uint64(sum(1 << (LOW_BITS * i) for i in range(LANES)))
    equal = 1.0 - np.bitwise_count(x & ones).sum(1, dtype=np.int64) / HASHES
    return (equal - 2.0**-LOW_BITS) / (1 - 2.0**-LOW_BITS)


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n, set_key, sig, bands) per row; the last three null without shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        n, keys, sigs, bands = [], [], [], []
        for text in batch.column("text").to_pylist():
            own = shingles(text, size)
            n.append(len(own))
            if not len(own):
                for out in (keys, sigs, bands):
                    out.append(None)
                continue
            low = minima(own)
            keys.append(xxhash.xxh3_128_digest(own.tobytes()))
            sigs.append(packed(low))
            bands.append(band_keys(low))
        longs = pa.list_(pa.int64())
        arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, longs), pa.array(bands, longs)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n", "set_key", "sig", "bands"])

    texts = docs.select("doc_id", "text", _text_key().alias("text_key"))
    return map_batches(texts, run, f"doc_id {kind}, text_key binary, n long, set_key binary, sig array<long>, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, all) for ``wanted`` (id, text_key): all distinct shingles of the text.

    The texts are looked for in place by the first 64 bits of their keys while
    the keys are few enough to be sent; else docs and keys are joined. The
    join on the whole key decides in both cases."""
    texts = docs.select("text", _text_key().alias("text_key"))
    few = wanted.count() <= MOST_KEYS
    if few:
        heads = wanted.select(F.conv(F.substring(F.hex("text_key"), 1, 16), 16, -10).cast("long").alias("head")).toArrow().column("head")
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(heads.to_numpy()))
    else:
        texts = texts.join(wanted.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])

    def run(batches):
        done: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column("text_key").to_pylist()
                hit = range(len(keys))
                if few:
                    own = np.array([int.from_bytes(k[:8], "big", signed=True) if k else 0 for k in keys], np.int64)
                    place = np.minimum(np.searchsorted(shared.value, own), max(len(shared.value) - 1, 0))
                    hit = np.flatnonzero(shared.value[place] == own).tolist() if len(shared.value) else []
                hit = [i for i in hit if keys[i] is not None and keys[i] not in done]
                hit = list({keys[i]: i for i in hit}.values())
                if few and len(done) < 1 << 16:  # copies of one text in a task are read once
                    done.update(keys[i] for i in hit)
                if hit:
                    sets = [shingles(part.column("text")[i].as_py(), size).view(np.int64) for i in hit]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["text_key", "all"])

    sets = texts.mapInArrow(run, "text_key binary, all array<long>").join(wanted, "text_key").select("id", "all")
    return sets.dropDuplicates(["id"])


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, id, slice) dealt by range, without rows alone in their bucket;
    a slice's first and last row may be alone, or go on in the next slice."""

    def run(batches):
        held, first = None, True  # the last row of what came before, not yet judged
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            own = table.column("bucket").to_numpy()
            same = own[1:] == own[:-1]
            keep = np.zeros(len(own), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= first if held is None else came
            first = False
            came = bool(keep[-1])
            yield from table.slice(0, len(own) - 1).filter(pa.array(keep[:-1])).to_batches()
            held = table.slice(len(own) - 1).to_batches()[0]
        if held is not None:
            yield held

    dealt = rows.select("bucket", "id").repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    return saved(dealt.mapInArrow(run, "bucket long, id long").withColumn(SLICE, F.spark_partition_id()), "minhash-members")


def _close_in_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (pivot, id) with ``linked``: whether 100 x intersection >= percent x union, on the full sets."""
    cut = sliced(pairs, ["pivot"], [F.col("id").asc()], lambda df: saved(df, "minhash-pairs"))
    spans = cut.select(SLICE, "pivot").distinct().join(full.select(F.col("id").alias("pivot"), F.col("all").alias("theirs")), "pivot")
    met = cut.join(full, "id").join(spans, [SLICE, "pivot"])
    both = F.size(F.array_intersect("all", "theirs"))
    linked = (100 + percent) * both >= percent * (F.size("all") + F.size("theirs"))
    return met.select("pivot", "id", linked.alias("linked"))


def _open_links(members: DataFrame, sign: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what all similar pairs of ``members`` (slice,
    bucket, id, part) of different parts connect. ``full`` holds all their sets."""
    lead = members.select(SLICE, "bucket").distinct().join(members.groupBy("bucket").agg(F.min("id").alias("lead")), "bucket")
    shared = members.join(lead, [SLICE, "bucket"]).select(F.col("lead").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    group = connected_components(saved(shared, "minhash-shared")).select(F.col("node").alias("id"), F.col("root").alias("grp"))
    own = members.select("id", "part").distinct().join(group, "id").join(sign, "id")
    blocks = F.greatest(F.ceil(F.sum("n") / MOST), F.least(F.lit(BLOCKS), F.ceil(F.sum("n") / FEW)))
    own = own.join(own.groupBy("grp").agg(blocks.alias("blocks")), "grp").join(full, "id")
    own = own.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "id", "part", "n", "sig", "all")

    def run(frame):
        second = frame["second"].to_numpy()
        if frame["i"].iat[0] == frame["j"].iat[0]:
            second = np.zeros(len(frame), bool)
        return pd.DataFrame(_block_links(frame, second, percent), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("grp", "i", "j").applyInPandas(run, "a long, b long")


def _block_links(frame, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two blocks of ``frame``, or
    within its one block, beyond what its parts connect already."""
    ids, n = frame["id"].to_numpy(), frame["n"].to_numpy()
    sig = np.stack(frame["sig"].to_numpy()).view(np.uint64)
    _, part = np.unique(frame["part"].to_numpy(), return_inverse=True)
    sets = frame["all"].to_numpy()
    out: list[tuple[int, int]] = []
    sides = [(~second, second), (second, ~second)] if second.any() else [(~second, ~second)]
    # Of two parts that differ one isn't the largest: its members ask.
    asks = part != np.bincount(part).argmax()
    for asking, asked in sides:
        queries, at = np.flatnonzero(asking & asks), np.flatnonzero(asked)
        if not len(queries) or not len(at):
            continue
        known, place = np.unique(np.concatenate([sets[i] for i in at]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in at])[:-1]])
        held = np.zeros(len(known) + 1, bool)
        for q in queries:
            maybe = (part[at] != part[q]) & (100 * np.minimum(n[at], n[q]) >= percent * np.maximum(n[at], n[q]))
            if maybe.any():
                maybe[maybe] = estimates(sig[at[maybe]], sig[q]) >= percent / 100 - MARGIN
            if not maybe.any():
                continue
            where = np.searchsorted(known, sets[q])
            where = where[known[np.minimum(where, len(known) - 1)] == sets[q]]
            held[where] = True
            both = np.add.reduceat(held[place], starts, dtype=np.int64)
            held[where] = False
            for i in at[maybe & ((100 + percent) * both >= percent * (n[at] + n[q]))]:
                if part[i] != part[q]:
                    part[part == part[i]] = part[q]
                    out.append((int(ids[q]), int(ids[i])))
    return out


def components(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(id, root) of the linked ids of ``sets`` (id, n, sig, bands, text_key),
    as all similar pairs connect them, the misses named above aside; None without a common bucket."""
    rows = sets.select("id", F.explode("bands").alias("bucket"))
    # Dealt by range, so a large bucket lies in several slices.
    members = _shared_buckets(rows).select(SLICE, "bucket", "id", F.col("id").alias("part"))
    sign = sets.select("id", "n", "sig")
    found = full = roots = None
    spark, wide = docs.sparkSession, 1
    count, settled = members.count(), True
    kept = []  # what later rounds read

    def with_sets(ids: DataFrame) -> DataFrame:
        if full is not None:
            ids = ids.join(full.select("id"), "id", "left_anti")
        wanted = saved(ids.join(sets.select("id", "text_key"), "id"), "minhash-wanted")
        if full is not None and wanted.isEmpty():
            return full
        kept.append(saved(_full_sets(docs, wanted, size), "minhash-sets"))
        return kept[-1] if full is None else full.unionByName(kept[-1])

    while count and settled:
        since = mark()
        # The same pivots in all buckets where it can be.
        draw = F.xxhash64(F.lit(wide), F.col("id"))
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("id", draw).alias("chosen"))
        if wide > 1:
            of = members.select(SLICE, "bucket").distinct().join(sizes, "bucket")
            share = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
            picked = members.join(of, [SLICE, "bucket"]).where((F.col("id") == F.col("chosen")) | (share < float(wide) / F.col("n")))
            pivots = saved(picked.select("bucket", F.col("id").alias("pivot")), "minhash-pivots")
        else:
            pivots = saved(sizes.select("bucket", F.col("chosen").alias("pivot")), "minhash-pivots")
        theirs = sign.select(F.col("id").alias("pivot"), F.col("n").alias("p_n"), F.col("sig").alias("p_sig"))
        parts = members.select("bucket", F.col("id").alias("pivot"), F.col("part").alias("p_part"))
        told = pivots.join(parts, ["bucket", "pivot"]).join(theirs, "pivot")
        told = members.select(SLICE, "bucket").distinct().join(told, "bucket")
        met = members.join(told, [SLICE, "bucket"]).where("part <> p_part")
        met = met.select("id", "pivot", "p_n", "p_sig").dropDuplicates(["id", "pivot"]).join(sign, "id")
        met = met.where(_close_in_size("n", "p_n", percent) & (estimate("sig", "p_sig") >= percent / 100 - MARGIN)).select("id", "pivot")
        # Where both are pivots, the pair stands once.
        pairs = met.select(F.least("id", "pivot").alias("id"), F.greatest("id", "pivot").alias("pivot")).distinct()
        pairs = saved(pairs, "minhash-candidates")
        full = with_sets(pairs.select("id").union(pairs.select(F.col("pivot").alias("id"))).distinct())
        kept.append(saved(_confirmed(pairs, full, percent), "minhash-judged"))
        right = kept[-1].where("linked").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        found = right if found is None else found.unionByName(right)
        of = connected_components(found)
        roots = of.select(F.col("node").alias("id"), "root")
        left = members.drop("part").join(pivots.select("bucket", F.col("pivot").alias("id")), ["bucket", "id"], "left_anti")
        left = left.join(roots, "id", "left").select(SLICE, "bucket", "id", F.coalesce("root", "id").alias("part"))
        left = saved(left, "minhash-left")
        open_ = left.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("bucket")
        spans = left.select(SLICE, "bucket").distinct().join(open_, "bucket")
        members = saved(left.join(spans, [SLICE, "bucket"]).select(SLICE, "bucket", "id", "part"), "minhash-members")
        forget(spark, since, [of, members, *kept])
        before, count = count, members.count()
        settled, wide = 2 * count <= before, 2 * wide
    if count:
        since = mark()
        full = with_sets(members.select("id").distinct())
        new = saved(_open_links(members, sign, full, percent), "minhash-links")
        of = connected_components(found.unionByName(new))
        roots = of.select(F.col("node").alias("id"), "root")
        forget(spark, since, [of])
    return roots


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    signed = saved(signatures(docs, size), "minhash-signed")
    some = [F.first(c).alias(c) for c in ("n", "sig", "bands")]
    sets = signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), *some)
    sets = saved(sets.withColumn("id", F.monotonically_increasing_id()), "minhash-distinct")
    roots = components(docs, sets, size, percent)
    named = sets.select("set_key", "id", "least")
    if roots is not None:
        named = saved(named.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "minhash-roots")
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.select("set_key", "root").join(least, "root")
    else:
        named = named.withColumnRenamed("least", "component_id")
    named = named.select("set_key", "component_id")
    # Rows meet their set's component slice by slice: a text may be a third of all rows.
    rows = sliced(signed.select("doc_id", F.col("n").alias("n_shingles"), "set_key"), ["set_key"], [], lambda df: saved(df, "minhash-rows"))
    spans = rows.where(F.col("set_key").isNotNull()).select(SLICE, "set_key").distinct().join(named, "set_key")
    out = rows.join(spans, [SLICE, "set_key"], "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
