from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from marginlens.plans.session import configure  # noqa: E402
from marginlens.sources.schemas import SCHEMAS  # noqa: E402
from marginlens.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("marginlens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = configure(builder, shuffle_partitions=8).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only where the session has none.
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marginlens-test-ckpt-"))
    yield session
    session.stop()


def D(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def order(
    order_id,
    order_date="2024-01-10",
    city="Mumbai",
    channel="MYNTRA",
    store_id=None,
    sku_id="S1",
    category="Shirts",
    mrp=1000,
    selling_price=800,
    discount_pct=0.2,
    qty=1,
    gross_revenue=None,
    commission=100,
    logistics_cost=50,
    cogs=300,
    packaging_cost=20,
):
    rev = Decimal(str(selling_price)) * qty if gross_revenue is None else gross_revenue
    return (
        order_id,
        day(order_date) if order_date else None,
        city,
        channel,
        store_id,
        sku_id,
        category,
        D(mrp),
        D(selling_price),
        D(discount_pct),
        qty,
        D(rev),
        D(commission),
        D(logistics_cost),
        D(cogs),
        D(packaging_cost),
    )


def ret(return_id, order_id, return_date="2024-01-15", reason="Size issue", refund=800, rev_log=90):
    return (return_id, order_id, day(return_date) if return_date else None, reason, D(refund), D(rev_log))


def make_tables(spark, orders=(), returns=(), skus=(), stores=(), spend=()) -> Tables:
    def df(name, rows):
        return spark.createDataFrame(list(rows), SCHEMAS[name])

    return Tables(
        dim_sku=df("dim_sku", skus),
        dim_store=df("dim_store", stores),
        fact_orders=df("fact_orders", orders),
        fact_returns=df("fact_returns", returns),
        fact_marketing_spend=df("fact_marketing_spend", spend),
    )


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
