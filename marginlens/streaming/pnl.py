"""The sales side of the daily P&L from order lines that arrive over time.

Lines land as files. Each run takes what is new (``availableNow``), adds it to
the day's sums held in state, and writes the sums that changed. State of a day
is dropped once the watermark passes its end, so state is bounded by the days
within the delay. A line that comes later than that isn't added; it is counted:
lines arrived less lines added, by cell.

A batch's output is a folder named by the batch's number and is overwritten
when the batch is run again after a failure, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import cents, from_cents
from ..sources.scratch import scratch_path
from ..sources.tables import Tables

CELL = ["order_date", "city", "channel", "category"]
AMOUNTS = {"gross_revenue": "gross_revenue", "marketplace_commission": "commission", "cogs": "cogs", "packaging": "packaging_cost", "logistics": "logistics_cost"}
LINE = ["order_id", *CELL, "mrp", "qty", *AMOUNTS.values()]
DELAY = "7 days"


def _sums() -> list[Column]:
    money = [F.sum(cents(c)).alias(name) for name, c in AMOUNTS.items()]
    return [F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("units_sold"), F.sum(cents("mrp") * F.col("qty")).alias("gross_mrp"), *money]


def added(lines: DataFrame, delay: str = DELAY) -> DataFrame:
    """The streaming sums of ``lines`` (a stream of order lines) by day and cell.
    Event time is the order date's midnight in UTC, whatever the session's zone."""
    at = F.timestamp_seconds(F.unix_date("order_date").cast("long") * 86400)
    timed = lines.withColumn("at", at).withWatermark("at", delay)
    sums = timed.groupBy(F.window("at", "1 day").alias("day"), *CELL[1:]).agg(*_sums())
    day = F.date_from_unix_date((F.unix_seconds("day.start") / 86400).cast("int"))
    return sums.withColumn("order_date", day).drop("day")


def advance(spark: SparkSession, landing: str, out: str, checkpoint: str, schema, delay: str = DELAY) -> None:
    """Take in all files that are new below ``landing``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = added(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landing), delay)
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def taken(spark: SparkSession, landing: str, out: str, schema) -> DataFrame:
    """The sums as they stand (a cell's last output), and per cell the lines
    that arrived too late, or without a date, to be added (``late_lines``)."""
    names = ["lines", "units_sold", "gross_mrp", *AMOUNTS]
    last = spark.read.parquet(out).groupBy(*CELL).agg(F.max(F.struct("batch", *names)).alias("last"))
    stands = last.select(*CELL, F.lit(0).cast("long").alias("arrived"), *[F.col(f"last.{n}").alias(n) for n in names])
    arrived = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(landing).groupBy(*CELL).agg(F.count(F.lit(1)).alias("arrived"))
    counted = arrived.select(*CELL, "arrived", *[F.lit(0).cast(stands.schema[n].dataType).alias(n) for n in names])
    # Stacked and summed, so null cells meet as well.
    both = stands.unionByName(counted).groupBy(*CELL).agg(*[F.sum(n).alias(n) for n in ("arrived", *names)])
    money = [from_cents(n).alias(n) for n in ("gross_mrp", *AMOUNTS)]
    return both.select(*CELL, "lines", "units_sold", *money, (F.col("arrived") - F.col("lines")).alias("late_lines"))


def arrivals(t: Tables, landing: str, slices: int = 3) -> list[DataFrame]:
    """The order lines in the order of a made-up delivery: up to five days
    after their date, in ``slices`` deliveries over the history, and last of
    all the lines whose order_id ends in 7, however old. Test data, not data of record."""
    behind = F.coalesce(F.col("order_id").endswith("7"), F.lit(False))
    days = t.fact_orders.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b")).first()
    came = F.datediff(F.date_add("order_date", F.length(F.coalesce("order_id", F.lit(""))) % 6), F.lit(days["a"]).cast("date"))
    span = F.datediff(F.lit(days["b"]).cast("date"), F.lit(days["a"]).cast("date")) + 6
    part = F.when(behind, slices).otherwise(F.coalesce(F.floor(came * slices / span), F.lit(0)))
    lines = t.fact_orders.select(*LINE)
    return [lines.where(part == i) for i in range(slices + 1)]


def streamed_daily_pnl(t: Tables, slices: int = 3) -> DataFrame:
    """The sales side of the daily P&L as a stream has taken it in by the end of all deliveries."""
    spark = t.spark
    landing, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("landing", "sums", "checkpoint"))
    schema = t.fact_orders.select(*LINE).schema
    for i, lines in enumerate(arrivals(t, landing, slices)):
        lines.write.parquet(f"{landing}/delivery-{i}")
        advance(spark, landing, out, checkpoint, schema)
    return taken(spark, landing, out, schema)
