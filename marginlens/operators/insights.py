"""Queries the reference describes for its BI report but gives no code for.
Where the text fixes no formula, the definition here is ours (say so in the
docstring)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import as_double, div0, exact_mean, gross_margin, merge_on_keys, money_sum, safe_ratio
from ..sources.tables import Tables
from .marts import daily_pnl, return_rate, sku_profitability

ONLINE, OFFLINE = "online", "offline"
OFFLINE_CHANNEL = "OFFLINE"


def bleeding_skus(t: Tables) -> DataFrame:
    """Q26: SKUs with a positive gross margin whose margin after returns is
    negative, worst first."""
    return (
        sku_profitability(t)
        .where((F.col("gross_margin") > 0) & (F.col("true_margin_post_returns") < 0))
        .orderBy(F.col("true_margin_post_returns").asc(), F.col("sku_id").asc_nulls_last(), F.col("category").asc_nulls_last())
    )


def cm_rolling_7d(t: Tables, days: int = 7) -> DataFrame:
    """Q27 (window ours): daily contribution margin per channel with its
    average over the last ``days`` calendar days present (a RANGE frame on the
    day number, so missing days are not counted). The frame runs over a
    per-day aggregate, so each channel partition holds one row per day."""
    daily = daily_pnl(t).groupBy("order_date", "channel").agg(F.sum("contribution_margin").alias("contribution_margin"))
    w = Window.partitionBy("channel").orderBy(F.unix_date("order_date")).rangeBetween(-(days - 1), 0)
    cm = F.col("contribution_margin")
    avg = F.when(F.count(cm).over(w) > 0, as_double(F.sum(cm).over(w)) / F.count(cm).over(w))
    return daily.select("order_date", "channel", "contribution_margin", avg.alias("cm_7d_avg"))


def channel_cm_per_spend(t: Tables) -> DataFrame:
    """Q28: per channel: share of total gross revenue, contribution margin,
    marketing spend, and margin per unit of spend (DIV0; NULL without spend)."""
    pnl = daily_pnl(t).groupBy("channel").agg(
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("contribution_margin").alias("contribution_margin"),
    )
    spend = (
        t.fact_marketing_spend.where(F.col("channel").isNotNull())
        .groupBy("channel")
        .agg(money_sum("marketing_spend").alias("marketing_spend"))
    )
    # The total is a window over the grouped rows, one per channel.
    pnl = pnl.select("*", F.sum("gross_revenue").over(Window.partitionBy()).alias("_total"))
    j = merge_on_keys(["channel"], pnl, spend)
    return j.select(
        "channel",
        "gross_revenue",
        safe_ratio("gross_revenue", "_total").alias("revenue_share"),
        "contribution_margin",
        "marketing_spend",
        div0("contribution_margin", "marketing_spend").alias("cm_per_spend"),
    )


def category_channel_margin(t: Tables) -> DataFrame:
    """Q29: return rate next to gross and post-return margin per category x
    channel (the return-rate heatmap with its margins). Each side reads the
    orders and the returns once."""
    keys = ["category", "channel"]
    pnl = daily_pnl(t).groupBy(*keys).agg(
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum(gross_margin("gross_revenue", "marketplace_commission", "cogs", "packaging", "logistics")).alias("gross_margin"),
        F.sum("contribution_margin").alias("contribution_margin"),
    )
    j = merge_on_keys(keys, return_rate(t), pnl)
    return j.select(
        *keys,
        "total_orders",
        "returned_orders",
        "return_rate",
        "gross_revenue",
        "net_revenue",
        "gross_margin",
        "contribution_margin",
        div0("contribution_margin", "net_revenue").alias("cm_pct"),
    )


# Fixed values (ours): the waterfall steps in display order, with the sign
# each P&L column takes. The first seven steps add up to the eighth.
WATERFALL_STEPS = (
    (1, "gross_mrp", (("gross_mrp", 1),)),
    (2, "discount", (("discount_value", 1),)),
    (3, "returns", (("refund_value", -1),)),
    (4, "commission", (("marketplace_commission", -1),)),
    (5, "cogs", (("cogs", -1),)),
    (6, "packaging", (("packaging", -1),)),
    (7, "logistics", (("logistics", -1), ("reverse_logistics", -1))),
    (8, "contribution_margin", (("contribution_margin", 1),)),
)


def cost_waterfall(t: Tables) -> DataFrame:
    """Q30 (signs ours): per channel, one row per waterfall step from revenue
    at MRP down to contribution margin; costs are negative amounts."""
    cols = sorted({c for _, _, parts in WATERFALL_STEPS for c, _ in parts})
    totals = daily_pnl(t).groupBy("channel").agg(*[F.sum(c).alias(c) for c in cols])

    def amount(parts):
        expr = None
        for c, sign in parts:
            term = F.col(c) if sign > 0 else -F.col(c)
            expr = term if expr is None else expr + term
        return expr.cast("decimal(38,2)")

    steps = F.array(
        *[F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"), amount(parts).alias("amount")) for no, name, parts in WATERFALL_STEPS]
    )
    return totals.select("channel", F.explode(steps).alias("s")).select("channel", "s.step_no", "s.step", "s.amount")


def underpriced_skus(t: Tables) -> DataFrame:
    """Q31 (definition ours): SKUs sold on two or more channels, whatever
    their names, with the spread between their dearest and cheapest mean
    channel price over the channels present (NULL-safe, unlike the parity
    view's sentinels), and the cheapest channel (ties go to the first channel
    name). Rows without a channel have none to rank.

    Prices are averaged per sku and channel, then the channels of a sku are
    ranked by ordinary aggregates (the cheapest is the least (price, name))."""
    keys = ["sku_id", "category", "mrp"]
    per_channel = (
        t.fact_orders.where(F.col("channel").isNotNull())
        .groupBy(*keys, "channel")
        .agg(exact_mean("selling_price").alias("asp"))
        .where(F.col("asp").isNotNull())
    )
    ranked = per_channel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.max("asp").alias("max_asp"),
        F.min(F.struct("asp", "channel")).alias("cheapest"),
    )
    return (
        ranked.where(F.col("n_channels") >= 2)
        .select(
            *keys,
            "n_channels",
            "max_asp",
            F.col("cheapest.asp").alias("min_asp"),
            (F.col("max_asp") - F.col("cheapest.asp")).alias("price_spread"),
            F.col("cheapest.channel").alias("cheapest_channel"),
        )
        .orderBy(F.col("price_spread").desc(), F.col("sku_id").asc_nulls_last())
    )


def overview_filtered(t: Tables, mode: str = "all", cities: list[str] | None = None) -> DataFrame:
    """Q32: the overview page's totals under the online / offline toggle and
    a city filter. The filters sit on grouping keys of the daily P&L, so
    Catalyst pushes them down to the fact scans."""
    p = daily_pnl(t)
    if mode == ONLINE:
        p = p.where(F.col("channel") != OFFLINE_CHANNEL)
    elif mode == OFFLINE:
        p = p.where(F.col("channel") == OFFLINE_CHANNEL)
    elif mode != "all":
        raise ValueError(f"mode must be 'all', 'online' or 'offline', not {mode!r}")
    if cities:
        p = p.where(F.col("city").isin(list(cities)))
    agg = p.agg(
        F.sum("order_count").alias("order_count"),
        F.sum("units_sold").alias("units_sold"),
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("contribution_margin").alias("contribution_margin"),
    )
    return agg.withColumn("contribution_margin_pct", div0("contribution_margin", "net_revenue"))
