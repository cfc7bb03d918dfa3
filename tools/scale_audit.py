"""Plan every registered query as it would be planned over large tables and
list its shuffles.

    python tools/scale_audit.py [sf_dir]

Broadcasts are disabled (no side of a 100 TB star schema is small except the
grouped frames, which AQE would broadcast after measuring them) and AQE is
off, so the printed plan is the static one. Every exchange is put in a class:
  grouped   partial sums of groups of the result (channel, day, sku ...)
  distinct  rows already deduplicated where they lie, one per order or return
            id, moved for an exact distinct count or key check: as many as
            the fact has in the worst case
  fact      rows of a fact as they are
  small     a dimension, the spend table, or rows of the result to be sorted
Only the queries in EXACT may have a ``distinct`` exchange, none a ``fact``
one, except the CSV scan, whose files have no layout.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from marginlens.plans import registry  # noqa: E402
from marginlens.plans.session import configure  # noqa: E402
from marginlens.sources.catalog import load_test_tables  # noqa: E402


# Queries with an exact COUNT(DISTINCT return_id), or a check of a key the fact is not bucketed by.
EXACT = {
    "return_rate",
    "category_return_rate",
    "category_channel_margin",
    "top_return_category",
    "return_rate_pair",
    "pk_violations",
}
FACTS = ("order_lines", "fact_returns", "fact_orders")


def exchange_classes(plan: str) -> list[tuple[str, str]]:
    """(class, partitioning) of every exchange of a plan in tree form."""
    lines = plan.split("\n")
    depth = [len(re.match(r"[\s:+\-]*", x)[0]) for x in lines]
    out = []
    for i, line in enumerate(lines):
        m = re.match(r"[\s:+\-]*(?:\*\(\d+\) )?Exchange (.*)", line)
        if not m:
            continue
        below = []
        for k in range(i + 1, len(lines)):
            if depth[k] <= depth[i]:
                break
            below.append(lines[k])
        first = next((x for x in below if re.search(r"Aggregate\(|Join |FileScan|Window |Generate |Scan ExistingRDD", x)), "")
        if "Aggregate(" in first:
            keys = first.partition("keys=")[2].partition("functions=")[0]
            kind = "distinct" if re.search(r"order_id|return_id", keys) else "grouped"
        elif any(f"{f}[" in x or f"/{f}" in x for x in below for f in FACTS) and not any("Aggregate(" in x for x in below):
            kind = "fact"
        else:
            kind = "small"
        out.append((kind, m[1][:90]))
    return out


def audit(plan: str) -> dict:
    found = exchange_classes(plan)
    return {
        "exchanges": found,
        "fact": [p for k, p in found if k == "fact"],
        "distinct": [p for k, p in found if k == "distinct"],
        "cartesian": ("CartesianProduct" in plan) or ("BroadcastNestedLoopJoin" in plan),
        "single": sum(p.startswith("SinglePartition") for _, p in found),
    }


def allowed(name: str, found: dict) -> bool:
    return not found["cartesian"] and not found["fact"] and (name in EXACT or not found["distinct"])


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = configure(
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false"), shuffle_partitions=8
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tables = load_test_tables(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    flagged = 0
    for spec in registry.SPECS:
        df = registry.apply(tables, spec.name)
        plan = df._jdf.queryExecution().executedPlan().toString()
        a = audit(plan)
        ok = allowed(spec.name, a)
        flagged += not ok
        kinds = {k: sum(x == k for x, _ in a["exchanges"]) for k in ("grouped", "distinct", "fact", "small")}
        print(f"{'ok  ' if ok else 'FLAG'} {spec.name:28s} {kinds} single={a['single']} cartesian={a['cartesian']}")
        for p in a["distinct"] + a["fact"]:
            print(f"       {p}")
    print(f"{len(registry.SPECS) - flagged}/{len(registry.SPECS)} without a disallowed shuffle or cartesian product")


if __name__ == "__main__":
    main()
