"""Daily report: a target day against the seven days before it.

The target day defaults to the last order date, looked up once (one value
from one column, as the reference looks it up) and used as a literal, like
an explicit date: the parquet scan gets the window as a pushed filter and
skips the row groups outside it (facts are sorted by date inside each
bucket). A Column may be passed instead, e.g. a scalar subquery.

Every window query filters the order rows to the window *before* grouping,
and cuts the returns down to those orders' before they are aggregated: the
returns are read, but only the window's are joined and summed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import (
    LAKH,
    as_double,
    cents,
    change_pct,
    contribution_margin,
    from_cents,
    merge_on_keys,
    money_sum,
    round_half_up,
    safe_ratio,
    sum_cents,
    zero_if_null,
)
from ..sources.tables import Tables
from .common import count_first, first_of_order, last_order_date, returns_per_order
from .dashboard import top_reasons

LOOKBACK_DAYS = 7


def target_day(t: Tables, target_date: str | date | Column | None = None) -> Column:
    """The report day: the last order date by default, a date literal when
    given as text or date, or any Column (e.g. ``max_order_date_col(t)``,
    a lazy scalar subquery)."""
    if target_date is None:
        return last_order_date(t)
    if isinstance(target_date, Column):
        return target_date
    return F.lit(str(target_date)).cast("date")


def _window_orders(t: Tables, d: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    return t.fact_orders.where(F.col("order_date").between(F.date_sub(d, days), d))


def daily_sums(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Order and return sums per order date, in one pass over the orders.

    Each order row meets its order's pre-aggregated returns (a left join,
    one row per order row), so one aggregation yields both sides; refunds are
    booked on the order's date. The reference joins the two daily sides on
    the date with ``=``, so the NULL-date group gets no refunds (``dated``)."""
    returns = returns_per_order(t, orders=orders)
    orders = t.fact_orders if orders is None else orders
    j = first_of_order(orders, "order_date").join(returns, "order_id", "left")
    dated = F.col("order_date").isNotNull()
    return j.groupBy("order_date").agg(
        money_sum("gross_revenue").alias("revenue"),
        count_first().alias("orders"),
        money_sum("commission").alias("commission"),
        money_sum("cogs").alias("cogs"),
        money_sum("packaging_cost").alias("pack"),
        money_sum("logistics_cost").alias("logistics"),
        from_cents(F.sum(F.when(dated, F.col("refund_c")))).alias("refunds"),
        from_cents(F.sum(F.when(dated, F.col("rev_log_c")))).alias("rev_log"),
    )


def daily_kpis(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Revenue, distinct orders, refunds and contribution margin per order date."""
    d = daily_sums(t, orders)
    refunds = zero_if_null("refunds")
    cm = contribution_margin("revenue", refunds, "commission", "cogs", "pack", "logistics", zero_if_null("rev_log"))
    return d.select("order_date", "revenue", "orders", refunds.alias("refunds"), cm.alias("contribution_margin"))


def daily_kpi_window(t: Tables, target_date=None) -> DataFrame:
    """Q15: per order date in [d-7, d] (both ends): revenue, orders, refunds,
    contribution margin."""
    d = target_day(t, target_date)
    return daily_kpis(t, _window_orders(t, d)).orderBy("order_date")


def baseline_compare(t: Tables, target_date=None) -> DataFrame:
    """Q16: the last day of the window against the mean of the days before it.

    "Today" is the last day present, the mean is over the days present
    before it (not over 7). An empty window gives no row; a window of one day
    gives NULL means. Means are exact: (sum - today) / (n - 1).
    """
    w = daily_kpis(t, _window_orders(t, target_day(t, target_date)))
    metrics = ("revenue", "orders", "contribution_margin")
    agg = w.agg(
        F.max("order_date").alias("date"),
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(m, "order_date").alias(f"{m}_today") for m in metrics],
        *[F.sum(m).alias(f"_{m}_sum") for m in metrics],
    )
    cols = [F.col("date")]
    for m in metrics:
        prior = F.when(F.col("_n") > 1, as_double(F.col(f"_{m}_sum") - F.col(f"{m}_today")) / (F.col("_n") - 1))
        cols += [
            F.col(f"{m}_today"),
            prior.alias(f"{m}_7d_avg"),
            change_pct(F.col(f"{m}_today"), prior).alias(f"{m}_change_pct"),
        ]
    return agg.where(F.col("date").isNotNull()).select(*cols)


def category_movers(t: Tables, target_date=None) -> DataFrame:
    """Q17: per category, revenue on d against the sum over [d-7, d-1]
    divided by 7 (always 7, even when days are missing).

    Only the window's rows are aggregated; categories without sales in the
    window come from the (tiny) distinct category list and keep 0 revenue
    and a NULL delta, as the reference's full-history scan would give.
    """
    d = target_day(t, target_date)
    rev = F.col("gross_revenue")
    win = (
        _window_orders(t, d)
        .groupBy("category")
        .agg(
            sum_cents(F.when(F.col("order_date") == d, cents(rev)).otherwise(0)).alias("today_rev"),
            sum_cents(F.when(F.col("order_date") < d, cents(rev)).otherwise(0)).alias("_prior"),
        )
    )
    cats = t.fact_orders.select("category").distinct()
    j = merge_on_keys(["category"], cats, win)
    avg_rev = as_double(zero_if_null("_prior")) / float(LOOKBACK_DAYS)
    today = zero_if_null("today_rev")
    return j.select(
        "category",
        today.alias("today_rev"),
        avg_rev.alias("avg_rev"),
        change_pct(today, avg_rev).alias("delta_pct"),
    )


def return_reasons_on_day(t: Tables, target_date=None, k: int = 3) -> DataFrame:
    """Q18: the k most frequent reasons among returns dated d."""
    d = target_day(t, target_date)
    return top_reasons(t.fact_returns.where(F.col("return_date") == d), k)


def insights_payload(t: Tables, target_date=None) -> DataFrame:
    """Q19: the daily report as one row: six headline numbers (lakh, rounded
    to 2; order counts truncated to integers), the category movers and the
    day's top reasons as record lists, and all of it as one JSON text.

    The date is the day asked for; the numbers of "today" are the last day
    present in the window, as in ``baseline_compare``. A window without orders
    gives no row. Fields without a value are in the JSON as null.

    The lists are bounded by the number of categories and by 3; they enter
    the row as scalar subqueries, so nothing is joined or collected.
    """
    d = target_day(t, target_date)
    base = baseline_compare(t, d)
    movers = category_movers(t, d)
    movers_list = movers.agg(
        F.array_sort(
            F.collect_list(F.struct("category", as_double("today_rev").alias("today_rev"), "avg_rev", "delta_pct"))
        ).alias("m")
    ).scalar()
    reasons = return_reasons_on_day(t, d)
    reasons_list = reasons.agg(
        F.array_sort(
            F.collect_list(F.struct("return_reason", "n")),
            lambda a, b: F.when(a["n"] > b["n"], -1)
            .when(a["n"] < b["n"], 1)
            .when(a["return_reason"] < b["return_reason"], -1)
            .when(a["return_reason"] > b["return_reason"], 1)
            .otherwise(0),
        ).alias("r")
    ).scalar()

    def lakhs(c: str) -> Column:
        return round_half_up(as_double(c) / LAKH, 2)

    row = base.select(
        F.date_format(d, "yyyy-MM-dd").alias("date"),
        lakhs("revenue_today").alias("revenue_today_lakhs"),
        lakhs("revenue_7d_avg").alias("revenue_7d_avg_lakhs"),
        F.col("orders_today").cast("bigint").alias("orders_today"),
        F.col("orders_7d_avg").cast("bigint").alias("orders_7d_avg"),
        lakhs("contribution_margin_today").alias("contribution_margin_today_lakhs"),
        lakhs("contribution_margin_7d_avg").alias("contribution_margin_7d_avg_lakhs"),
        movers_list.alias("category_movers"),
        reasons_list.alias("top_return_reasons_today"),
    )
    fields = F.struct(*[F.col(c) for c in row.columns])
    return row.withColumn("payload_json", F.to_json(fields, {"ignoreNullFields": "false"}))


def insights_fields(t: Tables, target_date=None) -> DataFrame:
    """Q19 in flat form: one row (path, text, num) per field of the payload,
    list entries numbered from 0. Text fields have ``text``, numbers ``num``."""
    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")

    def field(path: Column, text: Column = none_text, num: Column = none_num) -> Column:
        return F.struct(path.alias("path"), text.alias("text"), num.cast("double").alias("num"))

    def entries(name: str, texts: tuple[str, ...], nums: tuple[str, ...]) -> Column:
        def one(entry: Column, i: Column) -> Column:
            head = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."))
            parts = [field(F.concat(head, F.lit(c)), text=entry[c]) for c in texts]
            return F.array(*parts, *[field(F.concat(head, F.lit(c)), num=entry[c]) for c in nums])

        return F.flatten(F.transform(name, one))

    heads = [field(F.lit("date"), text=F.col("date"))]
    for c in (
        "revenue_today_lakhs",
        "revenue_7d_avg_lakhs",
        "orders_today",
        "orders_7d_avg",
        "contribution_margin_today_lakhs",
        "contribution_margin_7d_avg_lakhs",
    ):
        heads.append(field(F.lit(c), num=F.col(c)))
    every = F.concat(
        F.array(*heads),
        entries("category_movers", ("category",), ("today_rev", "avg_rev", "delta_pct")),
        entries("top_return_reasons_today", ("return_reason",), ("n",)),
    )
    return insights_payload(t, target_date).select(F.explode(every).alias("f")).select("f.path", "f.text", "f.num")


def daily_kpi_snapshot(t: Tables, target_date=None) -> DataFrame:
    """Q20: the dashboard's variant of Q15: revenue, orders and margin from
    combined cost and return-cost sums. ``SUM(refund) + SUM(reverse)`` is
    NULL (then 0) for a day where either sum is NULL, as in the reference."""
    d = target_day(t, target_date)
    s = daily_sums(t, _window_orders(t, d))
    costs = F.col("commission") + F.col("cogs") + F.col("pack") + F.col("logistics")
    ret_cost = F.col("refunds") + F.col("rev_log")
    return s.select(
        "order_date",
        F.col("revenue").alias("rev"),
        "orders",
        (F.col("revenue") - zero_if_null(ret_cost) - costs).alias("cm"),
    ).orderBy("order_date")


def max_order_date(t: Tables) -> DataFrame:
    """Q21: the default target day."""
    return t.fact_orders.agg(F.max("order_date").alias("max_order_date"))


def reason_share_vs_7d(t: Tables, target_date=None) -> DataFrame:
    """Q33 (definition ours): each reason's share of the returns dated d
    against its share of the returns dated [d-7, d-1], and the change in
    percentage points. Reasons with no return in the eight days are absent;
    a share over an empty day is NULL."""
    d = target_day(t, target_date)
    r = t.fact_returns.where(F.col("return_date").between(F.date_sub(d, LOOKBACK_DAYS), d))
    today = F.col("return_date") == d
    totals = r.agg(
        F.struct(
            F.count(F.when(today, F.lit(1))).alias("today"), F.count(F.when(~today, F.lit(1))).alias("prior")
        ).alias("t")
    ).scalar()
    g = r.groupBy("return_reason").agg(
        F.count(F.when(today, F.lit(1))).alias("n_today"), F.count(F.when(~today, F.lit(1))).alias("n_prior")
    )
    share_today = safe_ratio("n_today", totals.getField("today"))
    share_prior = safe_ratio("n_prior", totals.getField("prior"))
    return g.select(
        "return_reason",
        "n_today",
        share_today.alias("share_today"),
        "n_prior",
        share_prior.alias("share_prior"),
        ((share_today - share_prior) * 100.0).alias("share_change_pp"),
    ).orderBy(F.col("share_change_pp").desc_nulls_last(), F.col("return_reason").asc_nulls_last())


ANOMALY_KPIS = ("revenue", "orders", "contribution_margin")


def daily_anomalies(t: Tables, k: float = 2.0, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Q34 (rule ours): days where a KPI leaves mean +- k standard deviations
    of the days present in the ``lookback`` calendar days before it (at least
    two such days needed).

    The facts are aggregated to one row per day first (one pass); the
    baseline is a RANGE window over that per-day series, partitioned by KPI,
    so each window partition holds one row per calendar day, a size bounded
    by the calendar and not by the data. Moments are exact decimal sums; only
    the final mean and deviation are doubles.
    """
    daily = daily_kpis(t)
    long = daily.unpivot(
        "order_date",
        [F.col(m).cast("decimal(38,2)").alias(m) for m in ANOMALY_KPIS],
        "kpi",
        "value",
    )
    prior = Window.partitionBy("kpi").orderBy(F.unix_date("order_date")).rangeBetween(-lookback, -1)
    v = F.col("value")
    j = long.select(
        "order_date",
        "kpi",
        "value",
        F.count(v).over(prior).alias("n"),
        F.sum(v).over(prior).alias("s"),
        F.sum(v * v).over(prior).alias("ss"),
    )
    n = F.col("n")
    mean = as_double("s") / n
    var = as_double(n * F.col("ss") - F.col("s") * F.col("s")) / as_double(n * (n - 1))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    value = as_double("value")
    scored = j.where(n >= 2).select(
        "order_date", "kpi", value.alias("value"), mean.alias("mean_7d"), std.alias("std_7d"), n.alias("n_prior_days")
    )
    out = scored.where(F.abs(F.col("value") - F.col("mean_7d")) > F.lit(k) * F.col("std_7d"))
    return out.withColumn("direction", F.when(F.col("value") > F.col("mean_7d"), "spike").otherwise("drop"))
