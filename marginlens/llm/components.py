"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (reduced before the shuffle) and one join of
two written tables, so AQE can split the partition of a hub; no component is
ever gathered in one task or at the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node that can be reached. Self-links and null ends are left out."""
    link = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = saved(edges.where("a <> b").select(*link).distinct(), "cc-edges")
    state = _state(stars)
    while True:
        stars = _small(_large(stars))
        now = _state(stars)
        if now == state:
            break
        state = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return saved(stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "cc-roots")


def _state(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(got)


def _large(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return saved(out.distinct(), "cc-large")


def _small(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and the node, to the smallest."""
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return saved(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
