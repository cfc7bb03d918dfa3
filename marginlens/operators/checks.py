"""Load checks: row counts, revenue by channel in crore, order date range and
declared-key violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import CRORE, as_double, money_sum, round_half_up
from ..sources.schemas import PRIMARY_KEYS
from ..sources.tables import Tables


def table_counts(t: Tables) -> DataFrame:
    """Q22: row count per table (five one-row aggregates stacked)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in t.items()]
    return reduce(DataFrame.unionByName, parts)


def channel_revenue_cr(t: Tables) -> DataFrame:
    """Q23: revenue in crore, rounded to 2 places, by channel."""
    g = t.fact_orders.groupBy("channel").agg(money_sum("gross_revenue").alias("_rev"))
    return g.select("channel", round_half_up(as_double("_rev") / CRORE, 2).alias("revenue_cr")).orderBy(
        F.col("revenue_cr").desc_nulls_last(), F.col("channel").asc_nulls_last()
    )


def order_date_range(t: Tables) -> DataFrame:
    """Q24: first and last order date."""
    return t.fact_orders.agg(F.min("order_date").alias("min_order_date"), F.max("order_date").alias("max_order_date"))


def pk_violations(t: Tables) -> DataFrame:
    """Q25: per table, each declared key value that repeats, and the NULL key
    if present, with its row count. Orders are bucketed by their key, so
    they are counted without a shuffle; returns are bucketed by order id, so
    their key (unique but for violations) shuffles one row per return, which
    an exact check needs. The result holds only violating keys."""
    parts = []
    for name, key in PRIMARY_KEYS.items():
        df = getattr(t, name)
        g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            g.where((F.col("n") > 1) | F.col(key).isNull()).select(
                F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key_value"), "n"
            )
        )
    return reduce(DataFrame.unionByName, parts)
