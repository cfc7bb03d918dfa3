"""Queries along an order: as-of joins and cumulative shares.

Both run over range slices (``functions.slices``): no window holds a whole
channel or the whole table in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import cents, div0, from_cents
from ..functions.slices import running, sliced
from ..sources.scratch import saved
from ..sources.tables import Tables


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` that
    has equal keys and a time not after the row's own; nulls where there is
    none. Of right rows with equal keys and time, the largest in ``values``
    (in their order) counts. Null keys and null times meet nothing, as in a join.

    A merge: both sides are stacked, dealt by range over (keys, time), and the
    last right row seen is carried along, from slice to slice where a key has
    several. Work and memory are those of one sort; no pair is formed."""
    known = F.struct(*[F.col(v) for v in values])
    blank = F.lit(None)
    rights = right.where(F.col(right_time).isNotNull()).select(
        *on, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), known.alias("__known"), blank.cast(left_struct(left)).alias("__row")
    )
    lefts = left.select(*on, F.col(left_time).alias("__time"), F.lit(1).alias("__side"), blank.cast(rights.schema["__known"].dataType).alias("__known"), F.struct(*left.columns).alias("__row"))
    order = [F.col("__time").asc_nulls_first(), F.col("__side").asc(), F.col("__known").asc()]
    cut = sliced(rights.unionByName(lefts), on, order, lambda df: saved(df, "asof"))
    seen = running(cut, on, {"__seen": ("last", F.col("__known"))}).where("__side = 1")
    matched = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.col("__time").isNotNull())
    got = F.when(matched, F.col("__seen"))
    return seen.select("__row.*", *[got[v].alias(v) for v in values])


def left_struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def spend_known_at_order(t: Tables) -> DataFrame:
    """The last day with spend on an order's channel and category up to the
    order's date, and that day's spend. A day's rows of spend are summed first."""
    daily = t.fact_marketing_spend.groupBy("channel", "category", "spend_date").agg(from_cents(F.sum(cents("marketing_spend"))).alias("marketing_spend"))
    orders = t.fact_orders.select("order_id", "order_date", "channel", "category")
    return asof_join(orders, daily, ["channel", "category"], "order_date", "spend_date", ["spend_date", "marketing_spend"])


def sku_abc(t: Tables, a: float = 0.8, b: float = 0.95) -> DataFrame:
    """Pareto classes of the SKUs: in the order of their revenue, largest first
    (ties by sku_id), the revenue up to and including each, its share of all,
    and the class: A while the SKUs before hold less than ``a`` of the revenue,
    B while less than ``b``, else C. Without any revenue all are C."""
    skus = t.fact_orders.groupBy("sku_id").agg(F.sum(cents("gross_revenue")).alias("revenue_c"))
    skus = skus.withColumn("revenue_c", F.coalesce("revenue_c", F.lit(0)))
    order = [F.col("revenue_c").desc(), F.col("sku_id").asc_nulls_first()]
    cut = sliced(skus, [], order, lambda df: saved(df, "abc"))
    along = running(cut, [], {"upto_c": ("sum", F.col("revenue_c")), "rank": ("sum", F.lit(1))})
    total = cut.agg(F.sum("revenue_c")).first()[0] or 0
    share = div0("upto_c", F.lit(total))
    first = F.lit(total) > 0
    ahead = F.col("upto_c") - F.col("revenue_c")
    kind = F.when(first & (ahead < a * total), "A").when(first & (ahead < b * total), "B").otherwise("C")
    return along.select("sku_id", "rank", from_cents("revenue_c").alias("gross_revenue"), from_cents("upto_c").alias("cumulative_revenue"), share.alias("cumulative_share"), kind.alias("abc"))
