"""Physical plan shape: what should not shuffle, what should reach the scan."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL

from marginlens.operators import daily, marts
from marginlens.plans import registry
from marginlens.sources.catalog import load_test_tables
from tools.scale_audit import allowed, audit


@pytest.fixture(scope="module")
def t(spark):
    return load_test_tables(spark, SF_SMALL)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_returns_join_orders_without_shuffling_the_facts(t, no_broadcast):
    plan = _plan(marts.returns_analytics(t))
    assert "SortMergeJoin" in plan
    assert "Exchange hashpartitioning(order_id" not in plan


def test_daily_pnl_has_one_shuffle(t, no_broadcast):
    plan = _plan(marts.daily_pnl(t))
    assert "SortMergeJoin" in plan
    # only the small exchange on the group keys remains
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(order_date" in plan


def test_explicit_target_date_reaches_the_scan(t):
    df = daily.daily_kpi_window(t, "2001-07-31")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date,2001-07-24)" in plan


def test_default_target_date_reaches_the_scan(t):
    plan = _plan(daily.daily_kpi_window(t))
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date,2001-07-25)" in plan


def test_columns_are_pruned(t):
    plan = _plan(t.fact_orders.groupBy("city").count())
    assert "ReadSchema: struct<city:string>" in plan


def test_month_questions_push_the_month_to_the_scan(spark, t):
    from marginlens.operators import questions

    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = _plan(questions.top_skus_month(t, "1998-02-01"))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "GreaterThanOrEqual(order_date,1998-02-01)" in plan
    assert "LessThanOrEqual(order_date,1998-02-28)" in plan


def test_return_day_filter_reaches_the_scan(t):
    plan = _plan(daily.return_reasons_on_day(t, "2001-07-31"))
    assert "EqualTo(return_date,2001-07-31)" in plan


@pytest.mark.parametrize("name", [s.name for s in registry.SPECS])
def test_no_fact_shuffle_or_cartesian_join(t, no_broadcast, name):
    found = audit(_plan(registry.apply(t, name)))
    assert allowed(name, found), found


def test_the_audit_sees_what_it_looks_for(t, no_broadcast):
    o, r = t.fact_orders, t.fact_returns
    assert audit(_plan(o.repartition(3, "city")))["fact"]
    assert audit(_plan(o.join(r.withColumnRenamed("return_id", "sku_id"), "sku_id")))["fact"]
    assert audit(_plan(r.groupBy("return_id").count()))["distinct"]
    assert audit(_plan(o.crossJoin(r)))["cartesian"]
    grouped = audit(_plan(o.groupBy("city").count()))
    assert [k for k, _ in grouped["exchanges"]] == ["grouped"]


@pytest.mark.parametrize(
    ("name", "orders", "returns"),
    [
        ("return_rate", 1, 1),
        ("category_return_rate", 1, 1),
        ("top_return_category", 1, 1),
        ("return_rate_pair", 1, 1),
        ("channel_cm_per_spend", 1, 1),
        ("category_channel_margin", 2, 2),
    ],
)
def test_scans_of_the_facts(t, no_broadcast, name, orders, returns):
    plan = _plan(registry.apply(t, name))
    assert len(re.findall(r"FileScan parquet .*order_lines\[", plan)) == orders
    assert len(re.findall(r"FileScan parquet .*fact_returns\[", plan)) == returns


@pytest.mark.parametrize("name", ["daily_kpi_window", "baseline_compare", "daily_kpi_snapshot", "insights_payload", "cm_category_channel_month"])
def test_returns_are_cut_down_before_they_are_aggregated(t, no_broadcast, name):
    """Between the returns' scan and the first aggregate stands the semi join."""
    plan = _plan(registry.apply(t, name)).split("\n")
    scans = [i for i, line in enumerate(plan) if "fact_returns[order_id" in line and "refund_amount" in line]
    assert scans
    for i in scans:
        above = plan[:i]
        joins = [k for k, line in enumerate(above) if "LeftSemi" in line]
        aggregates = [k for k, line in enumerate(above) if re.search(r"HashAggregate\(keys=\[order_id", line)]
        assert joins and aggregates and max(joins) > max(aggregates)


@pytest.mark.parametrize(
    ("name", "cell"),
    [("top_return_category", "= FLIPKART"), ("top_reasons_category", "= STANDARD"), ("return_rate_pair", "= AJIO")],
)
def test_a_question_on_a_cell_cuts_the_returns_first(t, no_broadcast, name, cell):
    """The returns meet the cell's orders before anything is aggregated or sorted for a window, inside the buckets."""
    plan = _plan(registry.apply(t, name))
    lines = plan.splitlines()
    (returns,) = [i for i, x in enumerate(lines) if "FileScan" in x and "fact_returns" in x]
    orders = [i for i, x in enumerate(lines) if "FileScan" in x and "order_lines" in x]
    # The returns' side of its join: down from the join (after the other side, where that comes first).
    side = max([i for i, x in enumerate(lines[:returns]) if "SortMergeJoin" in x] + [i for i in orders if i < returns])
    assert not [x for x in lines[side + 1 : returns] if "Aggregate" in x or "Window" in x]
    assert "Exchange hashpartitioning(order_id" not in plan
    assert cell in plan
