"""Every query by name, with the parameters used on the test tables.

``run`` loads (once per session and data directory) the star schema over the
test tables and applies one query. ``publish`` is the output convention of the
registry: exact decimal amounts become doubles (converted once, from the exact
sums, so the value is the correctly rounded amount); every other type is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

from ..operators import checks, daily, dashboard, insights, marts, ordered, questions, restate, sessions
from ..sources.catalog import load_test_tables
from ..sources.csv import csv_totals
from ..sources.tables import Tables
from ..sources.testdata import read_source
from ..streaming import pnl as pnl_stream


@dataclass(frozen=True)
class QuerySpec:
    name: str
    func: Callable[..., DataFrame]
    params: dict[str, Any] = field(default_factory=dict)
    note: str = ""


# Parameters of the sample questions, chosen to exist in the test tables.
# It gives a row per month and channel, several hundred.
ADHOC_SQL = (
    "SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, channel, "
    "CAST(SUM(contribution_margin) AS DOUBLE) AS contribution_margin, "
    "CAST(SUM(returns_count) AS BIGINT) AS returns_count "
    "FROM marts.v_daily_pnl GROUP BY 1, 2 ORDER BY month, channel"
)

SPECS: tuple[QuerySpec, ...] = (
    QuerySpec("daily_pnl", marts.daily_pnl),
    QuerySpec("returns_analytics", marts.returns_analytics),
    QuerySpec("return_rate", marts.return_rate),
    QuerySpec("price_parity", marts.price_parity),
    QuerySpec("sku_profitability", marts.sku_profitability),
    QuerySpec("marketing_efficiency", marts.marketing_efficiency),
    QuerySpec("store_performance", marts.store_performance),
    QuerySpec("kpi_summary", dashboard.kpi_summary),
    QuerySpec("monthly_revenue", dashboard.monthly_revenue),
    QuerySpec("channel_revenue", dashboard.channel_revenue),
    QuerySpec("category_return_rate", dashboard.category_return_rate),
    QuerySpec("channel_cm_pct", dashboard.channel_cm_pct),
    QuerySpec("top_return_reasons", dashboard.top_return_reasons),
    QuerySpec("city_revenue", dashboard.city_revenue),
    QuerySpec("daily_kpi_window", daily.daily_kpi_window),
    QuerySpec("baseline_compare", daily.baseline_compare),
    QuerySpec("category_movers", daily.category_movers),
    QuerySpec("return_reasons_on_day", daily.return_reasons_on_day),
    QuerySpec("insights_payload", daily.insights_fields),
    QuerySpec("daily_kpi_snapshot", daily.daily_kpi_snapshot),
    QuerySpec("max_order_date", daily.max_order_date),
    QuerySpec("table_counts", checks.table_counts),
    QuerySpec("channel_revenue_cr", checks.channel_revenue_cr),
    QuerySpec("order_date_range", checks.order_date_range),
    QuerySpec("pk_violations", checks.pk_violations),
    QuerySpec("bleeding_skus", insights.bleeding_skus),
    QuerySpec("cm_rolling_7d", insights.cm_rolling_7d),
    QuerySpec("channel_cm_per_spend", insights.channel_cm_per_spend),
    QuerySpec("category_channel_margin", insights.category_channel_margin),
    QuerySpec("cost_waterfall", insights.cost_waterfall),
    QuerySpec("underpriced_skus", insights.underpriced_skus),
    QuerySpec("overview_filtered", insights.overview_filtered, {"mode": "online", "cities": ["Mumbai", "Delhi"]}),
    QuerySpec("reason_share_vs_7d", daily.reason_share_vs_7d),
    QuerySpec("daily_anomalies", daily.daily_anomalies),
    QuerySpec("top_return_category", questions.top_return_category, {"channel": "FLIPKART"}),
    QuerySpec(
        "cm_category_channel_month",
        questions.cm_category_channel_month,
        {"category": "PROMO", "channel": "MYNTRA", "month": "1998-03-01"},
    ),
    QuerySpec("top_skus_month", questions.top_skus_month, {"month": "1998-02-01", "k": 5}),
    QuerySpec("lowest_commission_channel", questions.lowest_commission_channel),
    QuerySpec("top_reasons_category", questions.top_reasons_category, {"category": "STANDARD", "k": 3}),
    QuerySpec("return_rate_pair", questions.return_rate_pair, {"category": "LARGE", "channel": "AJIO"}),
    QuerySpec("csv_totals", csv_totals),
    QuerySpec("restated_daily_pnl", restate.restated_daily_pnl),
    QuerySpec("streamed_daily_pnl", pnl_stream.streamed_daily_pnl),
    QuerySpec("spend_known_at_order", ordered.spend_known_at_order),
    QuerySpec("sku_abc", ordered.sku_abc),
    QuerySpec("adhoc_sql", questions.adhoc_sql, {"sql_text": ADHOC_SQL}),
)

BY_NAME = {s.name: s for s in SPECS}

# Queries of one source table that the star schema doesn't hold: (table, function).
OF_SOURCE: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "event_sessions": ("events", sessions.event_sessions),
}


def publish(df: DataFrame) -> DataFrame:
    """Top-level exact decimals to double; other columns unchanged (one
    projection, built from SQL expression text in one call)."""
    def q(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    exprs = [
        f"CAST({q(f.name)} AS DOUBLE) AS {q(f.name)}" if isinstance(f.dataType, DecimalType) else q(f.name)
        for f in df.schema.fields
    ]
    return df.selectExpr(*exprs)


def apply(tables: Tables, name: str, **overrides: Any) -> DataFrame:
    spec = BY_NAME[name]
    return publish(spec.func(tables, **{**spec.params, **overrides}))


def run(spark: SparkSession, sf_dir: str, name: str, materialize: bool = True, **overrides: Any) -> DataFrame:
    return apply(load_test_tables(spark, sf_dir, materialize_tables=materialize), name, **overrides)


def run_of_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, func = OF_SOURCE[name]
    return publish(func(read_source(spark, sf_dir, table)))
