"""Dashboard data layer: headline KPIs, monthly trend, channel and city
revenue, category return rates, channel margin and top return reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import (
    CRORE,
    LAKH,
    as_double,
    cents,
    contribution_margin,
    from_cents,
    money_sum,
    round_half_up,
    safe_ratio,
    sum_cents,
)
from ..sources.tables import Tables
from .common import count_first, first_of_order, returns_per_order

# The display abbreviation of the reason labels and the sign labels.
REASON_ABBREVIATION = ("not as expected", "≠ expected")
SIGN_LABELS = ("Profitable", "Loss-making")


def kpi_summary(t: Tables) -> DataFrame:
    """Q08: one row of headline KPIs.

    The orders aggregate runs on its own table, so the distinct count of
    ``order_id`` uses the table's bucketing (no shuffle of order ids). The
    returns totals come in as one scalar subquery (a struct, evaluated once)
    rather than a join of two one-row frames. Returns are counted whether or
    not their order exists, and ``SUM(refund + reverse)`` skips a row where
    either is NULL, as in the reference.
    """
    returns_totals = t.fact_returns.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(sum_cents(cents("refund_amount") + cents("reverse_logistics_cost")), F.lit(0)).alias("cost"),
        ).alias("totals")
    ).scalar()
    agg = first_of_order(t.fact_orders).agg(
        money_sum("gross_revenue").alias("revenue"),
        count_first().alias("orders"),
        (money_sum("commission") + money_sum("cogs") + money_sum("packaging_cost") + money_sum("logistics_cost")).alias("costs"),
    )
    returns = returns_totals.getField("n")
    return_cost = returns_totals.getField("cost")
    return agg.select(
        "revenue",
        "orders",
        (safe_ratio(returns, "orders") * 100.0).alias("return_rate"),
        (safe_ratio(F.col("revenue") - return_cost - F.col("costs"), "revenue") * 100.0).alias("cm_pct"),
    )


def monthly_revenue(t: Tables) -> DataFrame:
    """Q09: revenue in lakh and distinct orders per month, with a short label."""
    month = F.trunc("order_date", "month")
    g = t.fact_orders.groupBy(month.alias("month")).agg(
        money_sum("gross_revenue").alias("_rev"), F.countDistinct("order_id").alias("orders")
    )
    return g.select(
        "month",
        (as_double("_rev") / LAKH).alias("revenue_l"),
        "orders",
        F.date_format("month", "MMM ''yy").alias("month_label"),
    ).orderBy("month")


def channel_revenue(t: Tables) -> DataFrame:
    """Q10: revenue in lakh and commission as % of revenue, per channel."""
    g = t.fact_orders.groupBy("channel").agg(
        money_sum("gross_revenue").alias("_rev"), money_sum("commission").alias("_comm")
    )
    return g.select(
        "channel",
        (as_double("_rev") / LAKH).alias("revenue_l"),
        (safe_ratio("_comm", "_rev") * 100.0).alias("commission_pct"),
    ).orderBy(F.col("revenue_l").desc_nulls_last(), F.col("channel").asc_nulls_last())


def category_return_rate(t: Tables) -> DataFrame:
    """Q11: distinct returns per 100 distinct orders, per category."""
    from .marts import return_rate

    rr = return_rate(t, keys=("category",))
    return rr.select(
        "category",
        (safe_ratio(F.col("returned_orders").cast("double") * 100.0, "total_orders")).alias("return_rate"),
        F.col("total_orders").alias("orders"),
    ).orderBy(F.col("return_rate").desc_nulls_last(), F.col("category").asc_nulls_last())


def channel_cm_pct(t: Tables) -> DataFrame:
    """Q12 (definition ours): contribution margin as % of gross revenue per
    channel, rounded to one decimal, with a sign label. Returns are summed per
    order first, so an order with two returns counts its revenue once; the
    reference counts it once per return."""
    j = t.fact_orders.select(
        "order_id", "channel", "gross_revenue", "commission", "cogs", "packaging_cost", "logistics_cost"
    ).join(returns_per_order(t), "order_id", "left")
    g = j.groupBy("channel").agg(
        money_sum("gross_revenue").alias("rev"),
        F.coalesce(from_cents(F.sum("refund_c")), F.lit(0)).alias("refunds"),
        money_sum("commission").alias("comm"),
        money_sum("cogs").alias("cogs"),
        money_sum("packaging_cost").alias("pack"),
        money_sum("logistics_cost").alias("log"),
        F.coalesce(from_cents(F.sum("rev_log_c")), F.lit(0)).alias("rev_log"),
    )
    cm = contribution_margin("rev", "refunds", "comm", "cogs", "pack", "log", "rev_log")
    pct = round_half_up(safe_ratio(cm, "rev") * 100.0, 1)
    return (
        g.select("channel", pct.alias("cm_pct"))
        .withColumn("sign", F.when(F.col("cm_pct") >= 0, SIGN_LABELS[0]).otherwise(SIGN_LABELS[1]))
        .orderBy(F.col("cm_pct").desc_nulls_last(), F.col("channel").asc_nulls_last())
    )


def reason_counts(returns: DataFrame) -> DataFrame:
    return returns.groupBy("return_reason").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(returns: DataFrame, k: int) -> DataFrame:
    """The k most frequent reasons; ties broken by reason name. The grouped
    frame has one row per distinct reason, so the sort is small."""
    return (
        reason_counts(returns)
        .orderBy(F.col("n").desc(), F.col("return_reason").asc_nulls_last())
        .limit(k)
    )


def top_return_reasons(t: Tables, k: int = 5) -> DataFrame:
    """Q13: five most frequent return reasons with a shortened label."""
    old, new = REASON_ABBREVIATION
    return top_reasons(t.fact_returns, k).withColumn(
        "short_reason", F.replace(F.col("return_reason"), F.lit(old), F.lit(new))
    )


def city_revenue(t: Tables) -> DataFrame:
    """Q14: revenue in crore per city."""
    g = t.fact_orders.groupBy("city").agg(money_sum("gross_revenue").alias("_rev"))
    return g.select("city", (as_double("_rev") / CRORE).alias("revenue_cr")).orderBy(
        F.col("revenue_cr").desc_nulls_last(), F.col("city").asc_nulls_last()
    )
