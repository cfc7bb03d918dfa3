"""Distributed list ranking: how many elements follow each element of a linked
list that lies scattered over a table.

A sparse ruling set: about one element in ``SPREAD`` is a ruler (by a hash of
its number). Every element doubles its jump until it lands on a ruler or past
the end, which takes about log2(SPREAD * ln n) joins, and an element that has
landed only serves as a stepping stone. The rulers form a list ``SPREAD`` times
shorter, which is ranked in the same way; a list of at most ``SHORT`` elements
is walked by one task. Each element is met by few others, so no join is skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import saved

SPREAD = 64
SHORT = 1 << 14


def ranks(links: DataFrame, spread: int = SPREAD, short: int = SHORT) -> DataFrame:
    """(a, rank) for links (a long, b long): a's next element is b, null for
    the last one, whose rank is 0. Every b must be an a, and no two a share a b."""
    hops = F.when(F.col("b").isNotNull(), 1).otherwise(0).cast("long")
    return _ranked(saved(links.select("a", "b", hops.alias("hops")), "rank-links"), spread, short, 0)


def _ranked(links: DataFrame, spread: int, short: int, level: int) -> DataFrame:
    if links.count() <= short:
        return links.coalesce(1).mapInArrow(_walk, "a long, rank long")

    def ruler(c: str):
        return F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(spread)) == 0

    state = links.withColumn("landed", F.col("b").isNull() | ruler("b"))
    while True:
        going = state.where(~F.col("landed"))
        if going.isEmpty():
            break
        stone = state.select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("hops").alias("more"), F.col("landed").alias("there"))
        moved = going.join(stone, "b").select("a", F.col("to").alias("b"), (F.col("hops") + F.col("more")).alias("hops"), F.col("there").alias("landed"))
        state = saved(state.where("landed").unionByName(moved), "rank-state")
    rulers = saved(state.where(ruler("a")).select("a", "b", "hops"), "rank-rulers")
    above = _ranked(rulers, spread, short, level + 1).select(F.col("a").alias("b"), F.col("rank").alias("rest"))
    return state.join(above, "b", "left").select("a", (F.col("hops") + F.coalesce("rest", F.lit(0))).alias("rank"))


def _walk(batches):
    """At most ``SHORT`` elements, ranked one after another from the last."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hops", pa.int64())]))
    if not rows.num_rows:
        return
    a, hops = rows.column("a").to_numpy(), rows.column("hops").to_numpy()
    before = {b: i for i, b in enumerate(rows.column("b").to_pylist())}
    rank, at, total = np.zeros(len(a), np.int64), before[None], 0
    while at is not None:
        total += int(hops[at])
        rank[at] = total
        at = before.get(int(a[at]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(rank)], ["a", "rank"])
