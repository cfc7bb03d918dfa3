"""The seven mart views: daily P&L, returns, return rate, price parity, SKU
profitability, marketing efficiency and store performance.

Each function is lazy: ``Tables -> DataFrame``. Views built on other views
call them, so Catalyst sees (and prunes) one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import (
    cents,
    contribution_margin,
    div0,
    exact_mean,
    from_cents,
    gross_margin,
    merge_on_keys,
    money_sum,
    sum_cents,
    zero_if_null,
)
from ..sources.tables import Tables
from .common import count_first, first_of_order, order_rows_per_key, returns_per_order, shared_view

PNL_KEYS = ["order_date", "city", "channel", "category"]

# The channel pivot of the price parity view, in column order,
# and the four channels its spread is taken over.
PARITY_CHANNELS = (
    ("D2C_APP", "asp_d2c_app"),
    ("D2C_WEB", "asp_d2c_web"),
    ("MYNTRA", "asp_myntra"),
    ("FLIPKART", "asp_flipkart"),
    ("AJIO", "asp_ajio"),
    ("OFFLINE", "asp_offline"),
)
SPREAD_CHANNELS = ("D2C_APP", "MYNTRA", "FLIPKART", "AJIO")
SPREAD_EMPTY = 99999


@shared_view
def pnl_groups(t: Tables) -> DataFrame:
    return pnl_groups_of(t)


def pnl_groups_of(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Order and return sums per order_date x city x channel x category, in
    one pass over the order fact.

    Each order row meets its order's pre-aggregated returns (at most one row
    per order id, so a left join keeps one row per order row), and one
    aggregation computes both sides. That is the same as aggregating the two
    sides apart and joining them on the four keys: a return lands in its
    order row's group, once per order row carrying that id, as in a join of
    returns to orders. The join on the keys is a plain ``=``, so a group with a
    NULL key gets no returns; ``attached`` keeps exactly that rule.

    On the bucketed facts the join and the distinct count of order ids run
    inside the scan's partitions; the one shuffle is of the partial
    aggregates on the four keys. With ``orders`` (a part of the order fact)
    only their returns are aggregated.
    """
    keys = PNL_KEYS
    returns = returns_per_order(t, orders=orders)
    j = first_of_order(t.fact_orders if orders is None else orders, *keys).join(returns, "order_id", "left")
    attached = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return j.groupBy(*keys).agg(
        count_first().alias("order_count"),
        F.sum("qty").alias("units_sold"),
        sum_cents(cents("mrp") * F.col("qty")).alias("gross_mrp"),
        money_sum("gross_revenue").alias("gross_revenue"),
        money_sum("commission").alias("marketplace_commission"),
        money_sum("cogs").alias("cogs"),
        money_sum("packaging_cost").alias("packaging"),
        money_sum("logistics_cost").alias("logistics"),
        from_cents(F.sum(F.when(attached, F.col("refund_c")))).alias("refund_value"),
        from_cents(F.sum(F.when(attached, F.col("rev_log_c")))).alias("reverse_logistics"),
        F.sum(F.when(attached, F.col("n"))).alias("returns_count"),
    )


@shared_view
def daily_pnl(t: Tables) -> DataFrame:
    return daily_pnl_of(t)


def daily_pnl_of(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Q01: order_date x city x channel x category P&L waterfall, from gross
    revenue at MRP down to contribution margin (refunds booked on the order's
    date and attributes, not the return's)."""
    j = pnl_groups(t) if orders is None else pnl_groups_of(t, orders)
    refund = zero_if_null("refund_value")
    rev_log = zero_if_null("reverse_logistics")
    cm = contribution_margin("gross_revenue", refund, "marketplace_commission", "cogs", "packaging", "logistics", rev_log)
    net = F.col("gross_revenue") - refund
    return j.select(
        *PNL_KEYS,
        "order_count",
        "units_sold",
        zero_if_null("returns_count").alias("returns_count"),
        "gross_mrp",
        "gross_revenue",
        (F.col("gross_revenue") - F.col("gross_mrp")).alias("discount_value"),
        refund.alias("refund_value"),
        net.alias("net_revenue"),
        "marketplace_commission",
        "cogs",
        "packaging",
        "logistics",
        rev_log.alias("reverse_logistics"),
        cm.alias("contribution_margin"),
        div0(cm, net).alias("contribution_margin_pct"),
    )


def returns_analytics(t: Tables) -> DataFrame:
    """Q02: category x channel x city x reason: count, refunds, reverse
    logistics, mean days from order to return."""
    keys = ["category", "channel", "city", "return_reason"]
    # Per (order, reason): counts, cents, and the sum of return day numbers,
    # so the day gaps of all returns of an order add up exactly after the join:
    # sum(return_day - order_day) = sum(return_day) - n_dated * order_day.
    per_order = t.fact_returns.groupBy("order_id", "return_reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents("refund_amount")).alias("refund_c"),
        F.sum(cents("reverse_logistics_cost")).alias("rev_log_c"),
        F.sum(F.unix_date("return_date").cast("long")).alias("rd_sum"),
        F.count("return_date").alias("rd_n"),
    )
    # Each return meets every order row with its id (k of them): weight by k.
    j = per_order.join(order_rows_per_key(t, "category", "channel", "city", "order_date"), "order_id")
    k = F.col("k")
    dated = F.col("order_date").isNotNull()
    gap_sum = F.when(dated, (F.col("rd_sum") - F.col("rd_n") * F.unix_date("order_date").cast("long")) * k)
    gap_n = F.when(dated, F.col("rd_n") * k)
    return j.groupBy(*keys).agg(
        F.sum(F.col("n") * k).alias("return_count"),
        from_cents(F.sum(F.col("refund_c") * k)).alias("total_refund"),
        from_cents(F.sum(F.col("rev_log_c") * k)).alias("total_reverse_logistics"),
        F.when(F.sum(gap_n) > 0, F.sum(gap_sum).cast("double") / F.sum(gap_n)).alias("avg_days_to_return"),
    )


def return_rate(t: Tables, keys: tuple[str, ...] = ("category", "channel"), orders: DataFrame | None = None) -> DataFrame:
    """Q03: distinct orders, distinct returns and their ratio per group. With
    ``orders`` (a part of the order fact) only their returns are read on.

    One pass over each fact: distinct (keys, order id) pairs meet distinct
    (order id, return id) pairs, and the first return of each order is marked.
    Orders are then a plain sum of first rows, so only the return ids need a
    distinct count (two distinct counts would make Spark expand every row).
    The pairs deduplicate and join inside the order_id buckets; the exact
    distinct count shuffles the returned rows on (keys, return id).
    """
    if tuple(keys) == ("category", "channel") and orders is None:
        return _return_rate_cc(t)
    return _return_rate(t, keys, orders)


@shared_view
def _return_rate_cc(t: Tables) -> DataFrame:
    return _return_rate(t, ("category", "channel"))


def _return_rate(t: Tables, keys: tuple[str, ...], part: DataFrame | None = None) -> DataFrame:
    """Distinct orders, distinct returns and their ratio per group of ``keys``.
    With a ``part`` of the orders the returns meet it before anything else is
    done to them, in one scan of each fact; without, they are deduplicated
    first, so an id repeated in both facts doesn't multiply."""
    keys = list(keys)
    orders = first_of_order((t.fact_orders if part is None else part).select(*keys, "order_id"), *keys).where("first").drop("first")
    returns = t.fact_returns.select("order_id", "return_id")
    if part is not None:
        met = orders.join(returns, "order_id", "left").distinct()
        least = F.min("return_id").over(Window.partitionBy("order_id", *keys))
        return _rate_of(met.select(*keys, "order_id", "return_id", F.col("return_id").eqNullSafe(least).alias("first")), keys)
    # The rows of an order sorted by return id: a row with its rank for a number is the first of its id.
    by_id = Window.partitionBy("order_id").orderBy(F.col("return_id").asc_nulls_last())
    returns = returns.select("*", F.row_number().over(by_id).alias("_row"), F.rank().over(by_id).alias("_rank"))
    returns = returns.where(F.col("_row") == F.col("_rank")).select("order_id", "return_id", (F.col("_row") == 1).alias("first"))
    return _rate_of(orders.join(returns, "order_id", "left"), keys)


def _rate_of(met: DataFrame, keys: list[str]) -> DataFrame:
    counted = F.col("order_id").isNotNull() & F.coalesce("first", F.lit(True))
    g = met.groupBy(*keys).agg(F.sum(counted.cast("long")).alias("total_orders"), F.countDistinct("return_id").alias("returned_orders"))
    return g.select(*keys, "total_orders", "returned_orders", div0("returned_orders", "total_orders").alias("return_rate"))


def channel_asp(channel: str):
    """Exact mean selling price over the rows of one channel (NULL if none)."""
    price = F.when(F.col("channel") == channel, F.col("selling_price"))
    return exact_mean(price)


def price_parity(t: Tables) -> DataFrame:
    """Q04: mean selling price per channel for each sku x category x mrp,
    and the spread over the four online marketplaces.

    Spread keeps the reference's sentinel arithmetic: an absent channel
    counts as 0 for the maximum and as 99999 for the minimum, so no sale on
    any of the four gives -99999 and one sale gives 0. A mean of exactly 0
    makes the warehouse LEAST return NULL (Spark's least skips NULLs, so that
    case is spelled out).
    """
    g = t.fact_orders.groupBy("sku_id", "category", "mrp").agg(
        *[channel_asp(ch).alias(name) for ch, name in PARITY_CHANNELS]
    )
    names = dict(PARITY_CHANNELS)
    spread_cols = [F.col(names[ch]) for ch in SPREAD_CHANNELS]
    hi = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in spread_cols])
    lo = F.least(*[F.coalesce(c, F.lit(float(SPREAD_EMPTY))) for c in spread_cols])
    any_zero = F.exists(F.array(*spread_cols), lambda x: x == 0.0)
    spread = F.when(any_zero, F.lit(None).cast("double")).otherwise(hi - lo)
    return g.select("*", spread.alias("price_spread"))


@shared_view
def sku_groups(t: Tables) -> DataFrame:
    """Per sku x category: order sums, and the sku's return totals.

    One pass: order rows meet their order's pre-aggregated returns, one
    aggregation by sku x category, then the return sums are totalled per sku
    by a window over that (small) aggregate. A sku sold under two categories
    thus meets all its returns in both rows, as when returns are grouped per
    sku and joined back with ``=`` (so a NULL sku gets none)."""
    j = t.fact_orders.join(returns_per_order(t), "order_id", "left")
    g = j.groupBy("sku_id", "category").agg(
        F.sum("qty").alias("units_sold"),
        money_sum("gross_revenue").alias("gross_revenue"),
        money_sum("commission").alias("commission"),
        money_sum("cogs").alias("cogs"),
        money_sum("packaging_cost").alias("packaging"),
        money_sum("logistics_cost").alias("logistics"),
        F.sum("refund_c").alias("_refund_c"),
        F.sum("rev_log_c").alias("_rev_log_c"),
        F.sum("n").alias("_n"),
    )
    per_sku = Window.partitionBy("sku_id")
    has_sku = F.col("sku_id").isNotNull()
    return g.select(
        "sku_id",
        "category",
        "units_sold",
        "gross_revenue",
        "commission",
        "cogs",
        "packaging",
        "logistics",
        F.when(has_sku, from_cents(F.sum("_refund_c").over(per_sku))).alias("refunds"),
        F.when(has_sku, from_cents(F.sum("_rev_log_c").over(per_sku))).alias("rev_log"),
        F.when(has_sku, F.sum("_n").over(per_sku)).alias("return_count"),
    )


@shared_view
def sku_profitability(t: Tables) -> DataFrame:
    """Q05: per sku x category: units, revenue, returns, gross margin and
    true margin after returns. Returns are grouped per sku only, so a sku
    sold under two categories meets its returns in both rows (as in the
    reference)."""
    j = sku_groups(t)
    returns = zero_if_null("return_count")
    refunds = zero_if_null("refunds")
    rev_log = zero_if_null("rev_log")
    true_margin = contribution_margin("gross_revenue", refunds, "commission", "cogs", "packaging", "logistics", rev_log)
    return j.select(
        "sku_id",
        "category",
        "units_sold",
        "gross_revenue",
        returns.alias("returns"),
        div0(returns, "units_sold").alias("return_rate"),
        gross_margin("gross_revenue", "commission", "cogs", "packaging", "logistics").alias("gross_margin"),
        true_margin.alias("true_margin_post_returns"),
        div0(true_margin, F.col("gross_revenue") - refunds).alias("true_margin_pct"),
    )


@shared_view
def category_channel_pnl(t: Tables) -> DataFrame:
    """The daily P&L rolled up to category x channel (margin and net revenue)."""
    return daily_pnl(t).groupBy("category", "channel").agg(
        F.sum("contribution_margin").alias("contribution_margin"),
        F.sum("net_revenue").alias("net_revenue"),
    )


def marketing_efficiency(t: Tables) -> DataFrame:
    """Q06: margin against marketing spend per category x channel.
    Spend without sales is dropped; sales without spend get NULL spend and
    NULL ROMI; zero spend gives ROMI 0."""
    keys = ["category", "channel"]
    pnl = category_channel_pnl(t)
    # A plain ``=`` left join: spend under a NULL key meets nothing, so it is
    # dropped before the (NULL-matching) merge.
    spend = (
        t.fact_marketing_spend.where(F.col("category").isNotNull() & F.col("channel").isNotNull())
        .groupBy(*keys)
        .agg(money_sum("marketing_spend").alias("marketing_spend"))
    )
    j = merge_on_keys(keys, pnl, spend)
    return j.select(
        "category",
        "channel",
        "net_revenue",
        "contribution_margin",
        "marketing_spend",
        (F.col("contribution_margin") - F.col("marketing_spend")).alias("net_contribution"),
        div0("net_revenue", "marketing_spend").alias("romi"),
    )


def store_performance(t: Tables) -> DataFrame:
    """Q07: per store: orders, units, revenue and revenue per sqft.

    Orders are aggregated per store before meeting the (small) store
    dimension; rows without a store are dropped first since they can never
    match. A store without orders keeps its row with 0 orders and NULL sums.
    Regrouping after the join by the store attributes keeps the reference's
    result even if a store id repeats in the dimension.
    """
    keys = ["store_id", "city", "store_type", "sqft"]
    per_store = (
        t.fact_orders.where(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.sum("qty").alias("units"),
            money_sum("gross_revenue").alias("gross_revenue"),
        )
    )
    j = t.dim_store.select(*keys).join(per_store, "store_id", "left")
    g = j.groupBy(*keys).agg(
        zero_if_null(F.max("orders")).alias("orders"),
        F.sum("units").alias("units"),
        money_sum("gross_revenue").alias("gross_revenue"),
    )
    return g.select(
        *keys,
        "orders",
        "units",
        "gross_revenue",
        F.when(F.col("sqft") != 0, F.col("gross_revenue").cast("double") / F.col("sqft")).alias("revenue_per_sqft"),
    )
