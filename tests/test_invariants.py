
from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import SF_SMALL

from marginlens.functions.measures import round_half_up
from marginlens.operators import dashboard, insights, marts
from marginlens.sources.catalog import load_test_tables


@pytest.fixture(scope="module")
def t(spark):
    return load_test_tables(spark, SF_SMALL)


def _sum(df, col):
    from pyspark.sql import functions as F

    return df.agg(F.sum(col)).first()[0]


def test_pnl_and_sku_totals_agree(t):
    pnl, sku = marts.daily_pnl(t), marts.sku_profitability(t)
    assert _sum(pnl, "gross_revenue") == _sum(sku, "gross_revenue")
    assert _sum(pnl, "units_sold") == _sum(sku, "units_sold")
    (k,) = dashboard.kpi_summary(t).collect()
    assert k["revenue"] == _sum(pnl, "gross_revenue")


def test_marketing_margin_equals_pnl_margin(t):
    assert _sum(marts.marketing_efficiency(t), "contribution_margin") == _sum(marts.daily_pnl(t), "contribution_margin")


def test_channel_cm_pct_is_pnl_margin_over_gross(t):
    from pyspark.sql import functions as F

    by_channel = marts.daily_pnl(t).groupBy("channel").agg(
        F.sum("contribution_margin").alias("cm"), F.sum("gross_revenue").alias("rev")
    )
    expected = by_channel.select(
        "channel", round_half_up(F.col("cm").cast("double") / F.col("rev").cast("double") * 100.0, 1).alias("pct")
    )
    got = {r["channel"]: r["cm_pct"] for r in dashboard.channel_cm_pct(t).collect()}
    assert got == {r["channel"]: r["pct"] for r in expected.collect()}


def test_waterfall_closes_on_every_channel(t):
    steps: dict[str, dict[int, Decimal]] = {}
    for r in insights.cost_waterfall(t).collect():
        steps.setdefault(r["channel"], {})[r["step_no"]] = r["amount"]
    assert steps
    for s in steps.values():
        assert sum(s[i] for i in range(1, 8)) == s[8]


def test_one_true_key_violation_at_smallest_scale(t):
    from marginlens.operators.checks import pk_violations

    got = [(r["table_name"], r["n"]) for r in pk_violations(t).collect()]
    assert ("fact_orders", 2) in got
