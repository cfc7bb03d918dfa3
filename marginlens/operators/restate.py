"""A published daily P&L that late returns and changed lines restate in part.

The table is partitioned by period (the order date's day or month). A change
touches the periods of its orders; only these are recomputed, from a scan cut
down to their dates, and published by dynamic partition overwrite: untouched
partitions keep their files, and a repeated run writes the same partitions
again. A touched period that has no rows any more is removed.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..sources.tables import Tables
from .marts import daily_pnl, daily_pnl_of

GRAINS = ("day", "month")


def period_of(grain: str, day: Column | str = "order_date") -> Column:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}, not {grain!r}")
    return F.trunc(day, "month") if grain == "month" else F.col(day) if isinstance(day, str) else day


def _write(pnl: DataFrame, path: str, grain: str) -> None:
    of = pnl.withColumn("period", period_of(grain))
    # One file a period; a period's P&L is at most its cells, so no key is hot.
    of.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def publish(t: Tables, path: str, grain: str = "month") -> None:
    """The whole P&L as a new published table."""
    _write(daily_pnl(t), path, grain)


def published(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The published table, with the columns of ``schema`` (a P&L frame) and period."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return spark.read.schema(f"{kinds}, period date").parquet(path)


def touched_periods(t: Tables, late_returns: DataFrame, changed_orders: DataFrame, grain: str = "month") -> list[date | None]:
    """The periods a change touches: those of the orders the late returns
    belong to, and those of the changed lines (give a line whose date changed
    with both its dates). One value a calendar period, so the list is bounded
    by the history's length, not by its rows."""
    # order_id buckets meet the few late returns; only ids and dates are read.
    ids = late_returns.select("order_id").where(F.col("order_id").isNotNull()).distinct()
    of_returns = t.fact_orders.join(ids, "order_id", "left_semi").select(period_of(grain).alias("period"))
    both = of_returns.union(changed_orders.select(period_of(grain).alias("period"))).distinct()
    return sorted((r["period"] for r in both.collect()), key=lambda d: (d is not None, d))


def in_periods(periods: list[date | None], grain: str) -> Column:
    """The condition on order_date, as ranges that reach the scan."""
    if not periods:
        return F.lit(False)
    day = F.col("order_date")
    dated = [F.lit(p) for p in periods if p is not None]
    ends = [day.between(p, F.last_day(p) if grain == "month" else p) for p in dated]
    unknown = [day.isNull()] if None in periods else []
    return reduce(lambda a, b: a | b, ends + unknown)


def restate(t: Tables, path: str, late_returns: DataFrame, changed_orders: DataFrame, grain: str = "month") -> list[date | None]:
    """Recompute the periods touched by the change from ``t`` (the facts with
    the change in them) and publish them at ``path``. Returns the periods."""
    periods = touched_periods(t, late_returns, changed_orders, grain)
    if not periods:
        return []
    pnl = daily_pnl_of(t, t.fact_orders.where(in_periods(periods, grain)))
    _write(pnl, path, grain)
    _remove_emptied(t, path, periods, grain)
    return periods


def _remove_emptied(t: Tables, path: str, periods: list[date | None], grain: str) -> None:
    """Dynamic overwrite leaves a partition for which nothing is written."""
    left = t.fact_orders.where(in_periods(periods, grain)).select(period_of(grain).alias("period")).distinct()
    held = {r["period"] for r in left.collect()}
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    for p in periods:
        if p not in held:
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/period={p or '__HIVE_DEFAULT_PARTITION__'}")
            at.getFileSystem(conf).delete(at, True)


def restated_daily_pnl(t: Tables, days: int = 30, grain: str = "month") -> DataFrame:
    """The daily P&L after a restatement. First published: the books as of
    ``days`` before the last order date, without later orders, without returns
    dated later, and with no commission booked yet on that day. Then the later
    orders, the late returns and the commissions of that day arrive, and what
    they touch is restated. Equals the daily P&L of all facts; ``restated``
    tells the rows of touched periods."""
    last = t.fact_orders.agg(F.max("order_date").alias("d")).first()["d"]
    cut = F.date_sub(F.lit(last).cast("date"), days)
    known = F.coalesce(F.col("order_date") <= cut, F.lit(True))
    on_day = F.coalesce(F.col("order_date") == cut, F.lit(False))
    unbooked = F.when(on_day, F.lit(0)).otherwise(F.col("commission")).cast("decimal(12,2)")
    early_orders = t.fact_orders.where(known).withColumn("commission", unbooked)
    returned = F.coalesce(F.col("return_date") <= cut, F.lit(True))
    early = t.with_table("fact_orders", early_orders).with_table("fact_returns", t.fact_returns.where(returned))

    path = scratch_path(t.spark, "published-pnl")
    publish(early, path, grain)
    changed = t.fact_orders.where(F.col("order_date") >= cut)
    periods = restate(t, path, t.fact_returns.where(F.col("return_date") > cut), changed, grain)
    pnl = daily_pnl(t)
    of = published(t.spark, path, pnl)
    dated = [F.lit(p) for p in periods if p is not None]
    hit = F.col("period").isin(*dated) if dated else F.lit(False)
    if None in periods:
        hit = hit | F.col("period").isNull()
    return of.select(*pnl.columns, F.coalesce(hit, F.lit(False)).alias("restated"))
