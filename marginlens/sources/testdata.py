"""Map the driver's TPC-H-style test tables onto the retail star schema.

The reference ships no fact rows, so facts are derived from the test tables by
a fixed rule (see FIXTURES.md section 2). The derivation is one Spark job: a
chain of equi-joins and column expressions, all JVM-side.

Join order is chosen for scale: orders meets customer first (the orders side
is a quarter of lineitem, so that shuffle is the cheap one), then lineitem
meets the enriched orders once. Supplier and part are joined by key; at
test scale AQE broadcasts them, at cluster scale they are shuffle joins.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import dec
from .tables import Tables

# Fixed values of the mapping (FIXTURES.md section 2), in key order.
CHANNELS = ("D2C_APP", "D2C_WEB", "MYNTRA", "FLIPKART", "AJIO", "OFFLINE")
CITIES = ("Mumbai", "Delhi", "Bengaluru")
RETURN_REASONS = ("Size issue", "Quality not as expected", "Colour not as expected", "Late delivery", "Changed mind")
SPEND_CATEGORIES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")
COMMISSION_RATES = (("MYNTRA", "0.18"), ("FLIPKART", "0.20"), ("AJIO", "0.22"))
STORE_OPEN_BASE = "2020-01-01"


def _pick(values: tuple[str, ...], key: Column) -> Column:
    """``values[key % len(values)]``; NULL key gives NULL."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def channel_of(key: Column) -> Column:
    return _pick(CHANNELS, key)


def city_of(key: Column) -> Column:
    return _pick(CITIES, key)


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sku_columns() -> list[Column]:
    mrp = F.col("p_retailprice").cast("decimal(10,2)")
    return [
        F.concat(F.lit("SK"), F.col("p_partkey").cast("string")).alias("sku_id"),
        F.col("p_type").alias("category"),
        mrp.alias("mrp"),
        (mrp * dec("0.35")).cast("decimal(10,2)").alias("cogs"),
        (F.lit(15) + F.col("p_size") % 20).cast("decimal(10,2)").alias("packaging_cost"),
    ]


def sku_frame(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", *sku_columns())


def store_frame(supplier: DataFrame) -> DataFrame:
    flagship = F.col("s_suppkey") % 10 == 0
    return supplier.select(
        F.concat(F.lit("ST"), F.col("s_suppkey").cast("string")).alias("store_id"),
        city_of(F.col("s_nationkey")).alias("city"),
        F.when(flagship, "Flagship").otherwise("Standard").alias("store_type"),
        F.when(flagship, F.lit(10000)).otherwise(F.lit(1500) + F.lit(250) * (F.col("s_suppkey") % 7)).cast("int").alias("sqft"),
        F.date_add(F.lit(STORE_OPEN_BASE).cast("date"), (F.col("s_suppkey") % 365).cast("int")).alias("opened_date"),
    )


def order_lines(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """One row per lineitem with every fact_orders column plus the few line
    attributes that decide returns (``_flag``, ``_line``, ``_supp``, ``_part``).

    With ``buckets`` the rows are dealt by order_id into as many partitions,
    and before the columns are derived: the source's few columns are shuffled
    instead of the twenty they become."""
    lineitem = read_source(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"
    )
    orders = read_source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read_source(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = read_source(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", "p_size")

    order_head = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", F.to_date("o_orderdate").alias("order_date"), "c_nationkey"
    )
    # Fact meets fact: a sort-merge join. Without table statistics Spark
    # estimates a join's size as the product of its inputs, so the enriched
    # orders would look huge and the pruned lineitem small enough to
    # broadcast; the hint states what the join really is.
    lines = (
        lineitem.join(order_head.hint("merge"), lineitem.l_orderkey == order_head.o_orderkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .join(part, lineitem.l_partkey == part.p_partkey)
        .select(*lineitem.columns, "order_date", "c_nationkey", "s_nationkey", "p_type", "p_retailprice", "p_size")
    )
    order_id = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    if buckets:
        lines = lines.repartition(buckets, order_id)
    lines = lines.withColumn("p_partkey", F.col("l_partkey")).select("*", *sku_columns())

    offline = F.col("l_partkey") % 50 == 0
    channel = F.when(offline, F.lit("OFFLINE")).otherwise(channel_of(F.col("l_orderkey")))
    # Per-row arithmetic is kept within 18 digits (qty as NUMBER(4,0), the
    # unit complement of the discount as decimal(5,4)), so Spark computes it
    # on longs instead of BigDecimal.
    qty = F.col("l_quantity").cast("int")
    qty_d = qty.cast("decimal(4,0)")
    discount = F.col("l_discount").cast("decimal(6,4)")
    selling_price = (F.col("mrp") * (dec("1.0000") - discount)).cast("decimal(10,2)")
    gross_revenue = (selling_price * qty_d).cast("decimal(12,2)")
    rate = dec("0.00")
    for name, r in COMMISSION_RATES:
        rate = F.when(channel == name, dec(r)).otherwise(rate)

    staged = lines.select(
        order_id.alias("order_id"),
        "order_date",
        F.when(offline, city_of(F.col("s_nationkey"))).otherwise(city_of(F.col("c_nationkey"))).alias("city"),
        channel.alias("channel"),
        F.when(offline & (F.col("l_suppkey") % 10 != 9), F.concat(F.lit("ST"), F.col("l_suppkey").cast("string"))).alias(
            "store_id"
        ),
        "sku_id",
        "category",
        "mrp",
        selling_price.alias("selling_price"),
        discount.alias("discount_pct"),
        qty.alias("qty"),
        gross_revenue.alias("gross_revenue"),
        (gross_revenue * rate).cast("decimal(12,2)").alias("commission"),
        F.when(offline, F.lit(0)).otherwise(F.lit(60) + F.lit(5) * F.col("l_linenumber")).cast("decimal(10,2)").alias("logistics_cost"),
        (F.col("cogs") * qty_d).cast("decimal(12,2)").alias("cogs"),
        (F.col("packaging_cost") * qty_d).cast("decimal(10,2)").alias("packaging_cost"),
        F.col("l_returnflag").alias("_flag"),
        F.col("l_linenumber").alias("_line"),
        F.col("l_suppkey").alias("_supp"),
        F.col("l_partkey").alias("_part"),
    )
    return staged


FACT_ORDER_COLUMNS = (
    "order_id",
    "order_date",
    "city",
    "channel",
    "store_id",
    "sku_id",
    "category",
    "mrp",
    "selling_price",
    "discount_pct",
    "qty",
    "gross_revenue",
    "commission",
    "logistics_cost",
    "cogs",
    "packaging_cost",
)


def orders_from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(*FACT_ORDER_COLUMNS)


def returns_from_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("_flag") == "R").select(
        F.concat(F.lit("R-"), F.col("order_id")).alias("return_id"),
        "order_id",
        F.date_add("order_date", (F.lit(1) + F.col("_line") + F.col("_supp") % 7).cast("int")).alias("return_date"),
        _pick(RETURN_REASONS, F.col("_line") + F.col("_part")).alias("return_reason"),
        F.col("gross_revenue").alias("refund_amount"),
        (F.lit(80) + F.lit(10) * F.col("_line")).cast("decimal(10,2)").alias("reverse_logistics_cost"),
    )


def spend_frame(events: DataFrame) -> DataFrame:
    zero_cell = (F.col("event_id") % 6 == 4) & (F.col("user_id") % 6 == 5)
    return events.where(F.col("event_id") % 6 != 5).select(
        F.to_date("ts").alias("spend_date"),
        channel_of(F.col("event_id")).alias("channel"),
        _pick(SPEND_CATEGORIES, F.col("user_id")).alias("category"),
        F.when(zero_cell, F.lit(Decimal("0.00"))).otherwise(F.col("value").cast("decimal(12,2)")).cast("decimal(12,2)").alias(
            "marketing_spend"
        ),
    )


def build_tables(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> Tables:
    """Lazy star schema over the test tables. Pass ``lines`` to share one
    (e.g. persisted) computation of the order lines between the two facts."""
    lines = order_lines(spark, sf_dir) if lines is None else lines
    return Tables(
        dim_sku=sku_frame(read_source(spark, sf_dir, "part")).drop("p_partkey"),
        dim_store=store_frame(read_source(spark, sf_dir, "supplier")),
        fact_orders=orders_from_lines(lines),
        fact_returns=returns_from_lines(lines),
        fact_marketing_spend=spend_frame(read_source(spark, sf_dir, "events")),
    )
