"""As-of join against a plain search, Pareto classes against one ordered pass; plan shape of both."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import SF_SMALL, D, make_tables, order

from marginlens.operators import ordered
from marginlens.sources.catalog import load_test_tables


@pytest.mark.parametrize("slices", [1, 9])
def test_asof_join(spark, slices):
    rng = random.Random(slices)
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)])) for i in range(500)]
    right = [(rng.choice(["hot"] * 4 + ["a", None, "c"]), rng.choice([None, *range(0, 40, 3)]), rng.choice([None, *range(9)])) for _ in range(120)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = ordered.asof_join(
            spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["u", "v"]
        )
        got = [tuple(r) for r in df.collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

    def last(k, t):
        known = [(u, v is not None, v) for kk, u, v in right if k is not None and kk == k and u is not None and t is not None and u <= t]
        return (max(known, key=lambda x: (x[0], x[1], x[2] or 0))[::2]) if known else (None, None)

    assert len(got) == len(left)
    assert {r[0]: r[3:] for r in got} == {i: last(k, t) for i, k, t in left}


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([], "k string, u int, v int")
    assert [tuple(r) for r in ordered.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()] == [(1, "a", 5, None)]
    assert ordered.asof_join(left.limit(0), right, ["k"], "t", "u", ["v"]).count() == 0


def test_plans_have_no_nested_loop_and_no_single_partition_over_rows(spark):
    t = load_test_tables(spark, SF_SMALL)
    for df in (ordered.spend_known_at_order(t), ordered.sku_abc(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        # What one task sees is one row a slice: no scan below a single partition but through a grouping by slice.
        assert plan.count("Exchange SinglePartition") <= 1
        if "Exchange SinglePartition" in plan:
            below = plan.split("Exchange SinglePartition")[1]
            assert "keys=[__slice" in below.split("FileScan")[0]


def test_abc_classes(spark):
    day = "2024-01-10"
    orders = [order(f"O{i}", sku_id=s, gross_revenue=r, order_date=day) for i, (s, r) in enumerate([("a", 70), ("b", 12), ("c", 12), ("d", 5), ("e", 1), (None, 0)])]
    got = [tuple(r) for r in ordered.sku_abc(make_tables(spark, orders=orders)).orderBy("rank").collect()]
    assert [(r[0], r[1], r[5]) for r in got] == [("a", 1, "A"), ("b", 2, "A"), ("c", 3, "B"), ("d", 4, "B"), ("e", 5, "C"), (None, 6, "C")]
    assert [float(r[3]) for r in got] == [70, 82, 94, 99, 100, 100]
    assert ordered.sku_abc(make_tables(spark)).count() == 0
    none = ordered.sku_abc(make_tables(spark, orders=[order("O", gross_revenue=0)])).collect()
    assert [(r["cumulative_share"], r["abc"]) for r in none] == [(0.0, "C")]


def test_spend_of_a_day_is_summed(spark):
    spend = [(dt.date(2024, 1, 9), "MYNTRA", "Shirts", 5), (dt.date(2024, 1, 9), "MYNTRA", "Shirts", 7), (dt.date(2024, 1, 11), "MYNTRA", "Shirts", 9)]
    t = make_tables(spark, orders=[order("O1"), order("O2", order_date="2024-01-01")], spend=[(*s[:3], D(s[3])) for s in spend])
    got = {r["order_id"]: (r["spend_date"], r["marketing_spend"]) for r in ordered.spend_known_at_order(t).collect()}
    assert got["O1"][0] == dt.date(2024, 1, 9) and float(got["O1"][1]) == 12 and got["O2"] == (None, None)
