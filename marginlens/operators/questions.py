"""The reference's sample questions, as parameterised queries, and ad hoc SQL
over the registered tables and views.

A question restricted to one channel, category or month restricts the order
fact first; the views built on it then only ever read those rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import money_sum
from ..sources.catalog import run_sql
from ..sources.tables import Tables
from .common import month_start, order_rows_per_key, returns_per_order
from .dashboard import channel_revenue
from .marts import daily_pnl_of, return_rate


def _restrict(t: Tables, cond: Column) -> Tables:
    return t.with_table("fact_orders", t.fact_orders.where(cond))


def _in_month(month: str | date) -> Column:
    start = month_start(month)
    return F.col("order_date").between(start, F.last_day(start))


def top_return_category(t: Tables, channel: str = "FLIPKART") -> DataFrame:
    """Q35: the category with the highest return rate on a channel."""
    rr = return_rate(t, orders=t.fact_orders.where(F.col("channel") == channel))
    return rr.orderBy(F.col("return_rate").desc_nulls_last(), F.col("category").asc_nulls_last()).limit(1)


def cm_category_channel_month(t: Tables, category: str, channel: str, month: str | date) -> DataFrame:
    """Q36: contribution margin of one category on one channel in one month
    (one row; NULL margin when nothing sold)."""
    cond = (F.col("category") == category) & (F.col("channel") == channel) & _in_month(month)
    agg = daily_pnl_of(t, t.fact_orders.where(cond)).agg(F.sum("contribution_margin").alias("contribution_margin"))
    return agg.select(
        F.lit(category).alias("category"),
        F.lit(channel).alias("channel"),
        month_start(month).alias("month"),
        "contribution_margin",
    )


def top_skus_month(t: Tables, month: str | date, k: int = 5) -> DataFrame:
    """Q37: the k SKUs with the highest gross revenue in a month."""
    g = (
        t.fact_orders.where(_in_month(month))
        .groupBy("sku_id")
        .agg(money_sum("gross_revenue").alias("gross_revenue"), F.sum("qty").alias("units_sold"))
    )
    return g.orderBy(F.col("gross_revenue").desc_nulls_last(), F.col("sku_id").asc_nulls_last()).limit(k)


def lowest_commission_channel(t: Tables) -> DataFrame:
    """Q38: the channel with the lowest commission as % of revenue."""
    return channel_revenue(t).orderBy(F.col("commission_pct").asc_nulls_last(), F.col("channel").asc_nulls_last()).limit(1)


def top_reasons_category(t: Tables, category: str, k: int = 3) -> DataFrame:
    """Q39: the k most frequent return reasons for one category, all channels."""
    orders = _restrict(t, F.col("category") == category)
    per_order = returns_per_order(t, "return_reason", orders=orders.fact_orders).join(order_rows_per_key(orders), "order_id")
    counts = per_order.groupBy("return_reason").agg(F.sum(F.col("n") * F.col("k")).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("return_reason").asc_nulls_last()).limit(k)


def return_rate_pair(t: Tables, category: str, channel: str) -> DataFrame:
    """Q40: return rate of one category on one channel (no row if it never sold)."""
    cond = (F.col("category") == category) & (F.col("channel") == channel)
    return return_rate(t, orders=t.fact_orders.where(cond))


def adhoc_sql(t: Tables, sql_text: str, limit: int | None = None) -> DataFrame:
    """Q41: run SQL text over the tables (``fact_orders`` or
    ``raw.fact_orders``) and mart views (``v_daily_pnl`` or
    ``marts.v_daily_pnl``) and return its whole result; with ``limit`` a
    preview of that many rows."""
    out = run_sql(t, sql_text)
    return out if limit is None else out.limit(limit)


__all__ = [
    "top_return_category",
    "cm_category_channel_month",
    "top_skus_month",
    "lowest_commission_channel",
    "top_reasons_category",
    "return_rate_pair",
    "adhoc_sql",
]
