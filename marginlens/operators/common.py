"""Small shapes shared by several queries."""

from __future__ import annotations

import functools
import weakref
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cents
from ..sources.tables import Tables


def shared_view(fn):
    """Build a view's DataFrame once per ``Tables`` bundle.

    A DataFrame is an immutable plan, so the queries built on one view
    (nine build on the daily P&L) can share the object and skip rebuilding
    it through py4j. Nothing is cached but the plan: every execution reads
    the tables again."""
    plans: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    @functools.wraps(fn)
    def build(t: Tables) -> DataFrame:
        if t not in plans:
            plans[t] = fn(t)
        return plans[t]

    return build


def returns_of(t: Tables, orders: DataFrame | None) -> DataFrame:
    """The returns of the given orders (all returns without ``orders``): the
    returns are cut down to a window's or a category's orders before anything
    is aggregated. A return may be dated before its order in bad data, so its
    own date can't stand in for this."""
    if orders is None:
        return t.fact_returns
    return t.fact_returns.join(orders.select("order_id"), "order_id", "left_semi")


def returns_per_order(t: Tables, *keys: str, orders: DataFrame | None = None) -> DataFrame:
    """Returns pre-aggregated per order id (and any extra return columns):
    count, refund and reverse logistics in integer cents (``refund_c``,
    ``rev_log_c``, ``n``).

    Aggregating before the join keeps it linear: an order id repeated k times
    in orders and m times in returns meets one row instead of m, yet every
    sum and count over the joined pairs is the same (each order row carries
    its order's totals). On the bucketed facts this aggregation runs inside
    the scan's partitions, with no shuffle. With ``orders`` only the returns
    of those orders are aggregated."""
    return returns_of(t, orders).groupBy("order_id", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents("refund_amount")).alias("refund_c"),
        F.sum(cents("reverse_logistics_cost")).alias("rev_log_c"),
    )


def first_of_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``first``: true on one row of each (order id, keys), NULLs
    being equal. Counting the order ids of these rows by ``keys`` is an exact
    distinct count. It takes one sort inside the order_id buckets, which a
    join on the order id then needs no more; a distinct aggregate would hold
    every order row with all its sums, twice, in hash maps."""
    return df.withColumn("first", F.row_number().over(Window.partitionBy("order_id", *keys).orderBy("order_id")) == 1)


def count_first(c: str = "order_id") -> Column:
    """Distinct non-NULL values of ``c`` in a frame of ``first_of_order``."""
    return F.count(F.when(F.col("first"), F.col(c)))


def order_rows_per_key(t: Tables, *cols: str) -> DataFrame:
    """Order rows counted per (order id, cols): ``k`` is how many order rows
    carry that id and those attributes. Joining returns to this instead of
    to the order rows, and weighting by ``k``, gives the same sums as the
    row-level join while emitting one row per distinct key, however often an
    id repeats. Local to the order_id buckets (no shuffle), by one sort that
    the join on the order id uses as well."""
    of_key = Window.partitionBy("order_id", *cols).orderBy("order_id")
    whole = of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = t.fact_orders.select("order_id", *cols, F.count(F.lit(1)).over(whole).alias("k"), F.row_number().over(of_key).alias("_row"))
    return counted.where(F.col("_row") == 1).drop("_row")


def max_order_date_col(t: Tables) -> Column:
    """The last order date as a scalar subquery (lazy; planned once)."""
    return t.fact_orders.select(F.max("order_date")).scalar()


def last_order_date(t: Tables) -> Column:
    """The last order date, resolved now as a date literal.

    One aggregate over the single ``order_date`` column returns one value.
    Unlike a scalar subquery, a literal reaches the parquet scan of the
    window queries as a pushed filter, so on date-sorted buckets they read
    only the row groups of the window. An empty table gives a NULL date
    (and empty windows)."""
    value = t.fact_orders.agg(F.max("order_date").alias("d")).first()["d"]
    return F.lit(value).cast("date")


def month_start(value: str | date) -> Column:
    return F.trunc(F.lit(str(value)).cast("date"), "month")
