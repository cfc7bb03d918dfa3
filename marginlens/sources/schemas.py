"""The five input tables of the star schema, as Spark types.

Declared widths of text columns are not enforced (Spark strings have no
length); NUMBER(p,0) becomes an integer, NUMBER(p,s) an exact decimal.
"""

from pyspark.sql.types import DateType, DecimalType, IntegerType, StringType, StructField, StructType


def _s(name: str) -> StructField:
    return StructField(name, StringType(), True)


def _d(name: str, p: int, s: int) -> StructField:
    return StructField(name, DecimalType(p, s), True)


DIM_SKU = StructType(
    [_s("sku_id"), _s("category"), _d("mrp", 10, 2), _d("cogs", 10, 2), _d("packaging_cost", 10, 2)]
)

DIM_STORE = StructType(
    [
        _s("store_id"),
        _s("city"),
        _s("store_type"),
        StructField("sqft", IntegerType(), True),
        StructField("opened_date", DateType(), True),
    ]
)

FACT_ORDERS = StructType(
    [
        _s("order_id"),
        StructField("order_date", DateType(), True),
        _s("city"),
        _s("channel"),
        _s("store_id"),
        _s("sku_id"),
        _s("category"),
        _d("mrp", 10, 2),
        _d("selling_price", 10, 2),
        _d("discount_pct", 6, 4),
        StructField("qty", IntegerType(), True),
        _d("gross_revenue", 12, 2),
        _d("commission", 12, 2),
        _d("logistics_cost", 10, 2),
        _d("cogs", 12, 2),
        _d("packaging_cost", 10, 2),
    ]
)

FACT_RETURNS = StructType(
    [
        _s("return_id"),
        _s("order_id"),
        StructField("return_date", DateType(), True),
        _s("return_reason"),
        _d("refund_amount", 12, 2),
        _d("reverse_logistics_cost", 10, 2),
    ]
)

FACT_MARKETING_SPEND = StructType(
    [
        StructField("spend_date", DateType(), True),
        _s("channel"),
        _s("category"),
        _d("marketing_spend", 12, 2),
    ]
)

SCHEMAS = {
    "dim_sku": DIM_SKU,
    "dim_store": DIM_STORE,
    "fact_orders": FACT_ORDERS,
    "fact_returns": FACT_RETURNS,
    "fact_marketing_spend": FACT_MARKETING_SPEND,
}

# Declared primary keys (checked by the key-violation query; Spark does not enforce them).
PRIMARY_KEYS = {
    "dim_sku": "sku_id",
    "dim_store": "store_id",
    "fact_orders": "order_id",
    "fact_returns": "return_id",
}
