"""Distinct order ids counted by marking a row of each in one sort of the bucket."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL, make_tables, order, ret
from pyspark.sql import functions as F

from marginlens.operators import daily, dashboard, marts
from marginlens.operators.common import count_first, first_of_order, order_rows_per_key
from marginlens.plans import registry
from marginlens.sources.catalog import load_test_tables


@pytest.fixture(scope="module")
def t(spark):
    return load_test_tables(spark, SF_SMALL)


@pytest.fixture()
def odd(spark):
    """Repeated and NULL ids, an id under two categories and dates, NULL keys."""
    orders = [
        order("A"),
        order("A"),
        order("A", category="Jeans"),
        order("A", order_date="2024-01-11", category=None),
        order("A", order_date="2024-01-11", category=None),
        order(None),
        order(None),
        order("B", order_date=None),
        order("C", order_date="2024-01-11"),
    ]
    returns = [ret("r1", "A"), ret("r1", "A"), ret(None, "A"), ret("r2", "A"), ret("r1", "C"), ret(None, "B"), ret("r3", None)]
    return make_tables(spark, orders, returns)


def _sorted_plan(spark, df) -> str:
    """The plan as over large tables: nothing broadcast, all of it at once."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _held_orders(plan: str) -> list[str]:
    """Keys of the aggregates that hold a row per order id: those of the order rows."""
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan)
    return [k for k in keys if "order_id" in k and not re.fullmatch(r"order_id#\d+(, return_reason#\d+)?", k)]


def _order_sorts(plan: str) -> int:
    return len(re.findall(r"Sort \[order_id#", plan))


@pytest.mark.parametrize("name", ["daily_pnl", "daily_anomalies", "returns_analytics", "return_rate", "category_return_rate"])
def test_order_rows_are_sorted_once_and_not_held_in_maps(spark, t, name):
    plan = _sorted_plan(spark, registry.apply(t, name))
    assert not _held_orders(plan)
    assert _order_sorts(plan) == 2  # one for the orders, one for the returns


def test_a_part_of_the_orders_is_sorted_not_held(spark, t):
    """What a restatement recomputes."""
    late = t.fact_orders.where(F.col("order_date") >= "1998-01-01")
    assert not _held_orders(_sorted_plan(spark, marts.daily_pnl_of(t, late)))


def test_the_summary_holds_no_map_of_its_orders(spark, t):
    plan = _sorted_plan(spark, dashboard.kpi_summary(t))
    assert not re.findall(r"Aggregate\(keys=\[order_id", plan)
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("keys", [(), ("order_date",), tuple(marts.PNL_KEYS)])
def test_first_rows_count_as_distinct_ids(odd, keys):
    got = first_of_order(odd.fact_orders, *keys).groupBy(*keys).agg(count_first().alias("n"))
    want = odd.fact_orders.groupBy(*keys).agg(F.countDistinct("order_id").alias("n"))
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_order_rows_per_key_with_repeats_and_nulls(odd):
    got = order_rows_per_key(odd, "category", "order_date")
    want = odd.fact_orders.groupBy("order_id", "category", "order_date").agg(F.count(F.lit(1)).alias("k"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_return_rate_with_repeats_and_nulls(odd):
    met = odd.fact_orders.join(odd.fact_returns, "order_id", "left")
    want = met.groupBy("category").agg(F.countDistinct("order_id").alias("o"), F.countDistinct("return_id").alias("r"))
    got = marts.return_rate(odd, ("category",)).select("category", F.col("total_orders").alias("o"), F.col("returned_orders").alias("r"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_daily_sums_with_repeats_and_nulls(odd):
    got = {r["order_date"] and str(r["order_date"]): (r["orders"], r["revenue"]) for r in daily.daily_sums(odd).collect()}
    want = odd.fact_orders.groupBy("order_date").agg(F.countDistinct("order_id").alias("orders"), F.sum("gross_revenue").alias("revenue"))
    assert got == {r["order_date"] and str(r["order_date"]): (r["orders"], r["revenue"]) for r in want.collect()}
