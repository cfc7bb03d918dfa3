"""URL filters by a cascade of Bloom filters.

A rule names a host and a path prefix and a verdict. A URL offers one key for
each suffix of its host and each prefix of its path that is as long as some
rule's path; a rule fits when its key is among them. The keys of all URLs are
the corpus's complete key universe, so a cascade can answer membership in the
rule set without error: level 1 holds the listed keys, level 2 the keys of the
universe that level 1 takes wrongly, level 3 the listed keys that level 2
takes wrongly, and so on until a level has no false positive. A key is listed
if the first level that lacks it is an even one. One cascade per verdict, no
join with the URLs.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
lower case; path: what follows up to ``?``, ``#`` or the end. Null and URLs
without ``://`` have an empty host and path. Such URLs fit no rule. Repeated
pages are judged one by one. The longest rule (host, then path) wins; if no
rule fits, ``otherwise`` is the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import map_batches, saved

VERDICTS = ("block", "allow")  # the first wins where a key is listed for both
BITS_PER_KEY = 12
#: Bytes of filters that are sent to the executors at once; a longer list is
#: split by a hash of the key and judged in several passes.
MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Bloom:
    bits: np.ndarray
    hashes: int
    seed: int

    def holds(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = places(keys, self.hashes, self.seed, len(self.bits) * 64)
        return ((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def places(keys: list[bytes], hashes: int, seed: int, size: int) -> np.ndarray:
    """The bit positions of each key, (keys, hashes), by double hashing."""
    pairs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, seed) for k in keys), "<u8").reshape(-1, 2)
    steps = pairs[:, :1] + np.arange(hashes, dtype=np.uint64) * (pairs[:, 1:] | np.uint64(1))
    return (steps % np.uint64(size)).astype(np.int64)


def build_bloom(keys: DataFrame, n: int, seed: int) -> Bloom:
    """A filter of the column ``key``; the bits are joined by 64-bit words, so
    only the filter itself reaches the driver."""
    words = max(1, ceil(n * BITS_PER_KEY / 64))
    hashes = max(1, round(BITS_PER_KEY * log(2)))

    def run(batch):
        own = [k.encode() for k in batch.column("key").to_pylist()]
        at = places(own, hashes, seed, words * 64).ravel() if own else np.zeros(0, np.int64)
        bits = np.uint64(1) << (at & 63).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = map_batches(keys.select("key"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(words, np.uint64)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Bloom(bits, hashes, seed)


def listed_in(cascade: list[Bloom], keys: list[bytes]) -> np.ndarray:
    """Exact membership for keys of the universe the cascade was built over."""
    out = np.zeros(len(keys), bool)
    rest = np.arange(len(keys))
    for level, bloom in enumerate(cascade):
        holds = bloom.holds([keys[i] for i in rest])
        out[rest[~holds]] = level % 2 == 1
        rest = rest[holds]
    out[rest] = len(cascade) % 2 == 1
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without a ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def url_keys(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix), the longest host first, then the longest path."""
    if not host:
        return []
    parts = host.split(".")
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [(".".join(parts[i:]), p) for i in range(len(parts)) for p in prefixes]


def _universe(pages: DataFrame, lengths: list[int], firsts: dict[str, Bloom], shard: int, shards: int) -> DataFrame:
    """(verdict, key): the keys of all pages that the first level takes."""
    shared = pages.sparkSession.sparkContext.broadcast(firsts)

    def run(batch):
        keys = {h + p for u in batch.column("url").to_pylist() for h, p in url_keys(*split_url(u), lengths)}
        keys = [k for k in keys if _shard(k, shards) == shard]
        coded = [k.encode() for k in keys]
        rows = [(v, k) for v, bloom in shared.value.items() for k, holds in zip(keys, bloom.holds(coded)) if holds]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.string())], ["verdict", "key"])

    return map_batches(pages.select("url"), run, "verdict string, key string").distinct()


def _shard(key: str, shards: int) -> int:
    return xxhash.xxh64_intdigest(key.encode()) % shards


def cascades(pages: DataFrame, listed: DataFrame, lengths: list[int], shard: int = 0, shards: int = 1) -> dict[str, list[Bloom]]:
    """One exact cascade per verdict over the keys of ``pages``. listed: (verdict, key)."""
    counts = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    own = {v: listed.where(F.col("verdict") == v).select("key") for v in VERDICTS if counts.get(v)}
    out = {v: [build_bloom(keys, counts[v], 1)] for v, keys in own.items()}
    if not out:
        return {}
    taken = saved(_universe(pages, lengths, {v: b[0] for v, b in out.items()}, shard, shards), "url-level1")
    for v, keys in own.items():
        # Not listed, yet taken: keys that occur on the universe's side only.
        both = taken.where(F.col("verdict") == v).select("key", F.lit(0).alias("on")).union(keys.select("key", F.lit(1)))
        inside, outside = keys, saved(both.groupBy("key").agg(F.max("on").alias("on")).where("on = 0").select("key"), "url-wrong")
        while n := outside.count():
            seed = len(out[v]) + 1
            out[v].append(build_bloom(outside, n, seed))
            inside, outside = outside, saved(_taken(inside, out[v][-1]), "url-wrong")
    return out


def _taken(keys: DataFrame, bloom: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bloom)

    def run(batch):
        own = batch.column("key")
        yield pa.RecordBatch.from_arrays([own.filter(pa.array(shared.value.holds([k.encode() for k in own.to_pylist()])))], ["key"])

    return map_batches(keys.select("key"), run, "key string")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id,
    url). rules: (host, path, verdict), hosts in lower case, verdict allow or
    block; rules with nulls take no part."""
    listed = rules.where(F.col("verdict").isin(*VERDICTS)).select("verdict", F.concat("host", "path").alias("key"), F.length("path").alias("n"))
    listed = saved(listed.where(F.col("key").isNotNull()).distinct(), "url-rules")
    lengths = sorted((r["n"] for r in listed.select("n").distinct().collect()), reverse=True)
    shards = max(1, ceil(listed.count() * BITS_PER_KEY * 2 / 8 / MOST_BYTES))
    key_shard = F.udf(lambda k: _shard(k, shards), "int") if shards > 1 else None
    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("found"))
    for shard in range(shards):
        part = listed if shards == 1 else listed.where(key_shard("key") == shard)
        built = cascades(pages, part.select("verdict", "key"), lengths, shard, shards)
        out = _judged(out, built, lengths, shard, shards, kind)
        if shard < shards - 1:
            out = saved(out, "url-judged")
    return _parted(out, kind, otherwise)


def _judged(pages: DataFrame, built: dict[str, list[Bloom]], lengths: list[int], shard: int, shards: int, kind: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(built)

    def run(batch):
        urls = batch.column("url").to_pylist()
        per_url = [[k for k in url_keys(*split_url(u), lengths) if shards == 1 or _shard("".join(k), shards) == shard] for u in urls]
        flat = list(dict.fromkeys(h + p for keys in per_url for h, p in keys))
        coded = [k.encode() for k in flat]
        verdict: dict[str, str] = {}
        for v in reversed(VERDICTS):
            if v in shared.value:
                verdict |= {k: v for k, yes in zip(flat, listed_in(shared.value[v], coded)) if yes}
        rules, found = batch.column("rule").to_pylist(), batch.column("found").to_pylist()
        for i, keys in enumerate(per_url):
            for h, p in keys:
                if h + p in verdict:
                    if rules[i] is None or (len(h), len(p)) > _parts_of(rules[i]):
                        rules[i], found[i] = h + p, verdict[h + p]
                    break
        cols = [batch.column("page_id"), batch.column("url"), pa.array(rules, pa.string()), pa.array(found, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "rule", "found"])

    return map_batches(pages, run, f"page_id {kind}, url string, rule string, found string")


def _parts_of(rule: str) -> tuple[int, int]:
    host = rule.partition("/")[0]
    return len(host), len(rule) - len(host)


def _parted(pages: DataFrame, kind: str, otherwise: str) -> DataFrame:
    def run(batch):
        both = [split_url(u) for u in batch.column("url").to_pylist()]
        verdict = [v or otherwise for v in batch.column("found").to_pylist()]
        cols = [batch.column("page_id"), pa.array([h for h, _ in both], pa.string()), pa.array([p for _, p in both], pa.string()), batch.column("rule"), pa.array(verdict, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(pages, run, f"page_id {kind}, host string, path string, rule string, verdict string")
