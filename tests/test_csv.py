"""CSV load layer: typed (warehouse file format) and inferred readers."""

import datetime as dt
import os

import pytest
from conftest import D, make_tables, order, ret, rows
from pyspark.sql import functions as F

from marginlens.functions.measures import cents
from marginlens.plans import registry
from marginlens.sources.csv import load_csv_dir, read_csv_inferred, read_csv_typed, write_csv_dir

STORE_CSV = """store_id,city,store_type,sqft,opened_date
ST1,Mumbai,Standard,1800,2023-10-10
ST2,NULL,Flagship,,2024-01-01
ST3,,"",2500,
"ST4","Delhi, NCR",Standard,3000,2025-04-20
"""


def test_typed_csv_reads_null_empty_and_quoted_empty_as_null(spark, tmp_path):
    p = tmp_path / "dim_store.csv"
    p.write_text(STORE_CSV)
    got = {r["store_id"]: r for r in rows(read_csv_typed(spark, str(p), "dim_store"))}
    assert got["ST1"]["sqft"] == 1800 and got["ST1"]["opened_date"] == dt.date(2023, 10, 10)
    assert got["ST2"]["city"] is None and got["ST2"]["sqft"] is None
    assert got["ST3"]["city"] is None and got["ST3"]["store_type"] is None and got["ST3"]["opened_date"] is None
    assert got["ST4"]["city"] == "Delhi, NCR"


def test_inferred_csv_types(spark, tmp_path):
    p = tmp_path / "dim_sku.csv"
    p.write_text("sku_id,category,mrp,cogs,packaging_cost\nSN1,Shirts,1599,463.07,20.5\nSN2,Jeans,1799,534.18,17.05\n")
    df = read_csv_inferred(spark, str(p))
    types = dict(df.dtypes)
    assert types["mrp"] == "int" and types["cogs"] == "double"


CSV_FILES = {
    "dim_sku": "sku_id,category,mrp,cogs,packaging_cost\nS1,Shirts,1000,350,20\n",
    "dim_store": STORE_CSV,
    "fact_orders": (
        "order_id,order_date,city,channel,store_id,sku_id,category,mrp,selling_price,discount_pct,qty,"
        "gross_revenue,commission,logistics_cost,cogs,packaging_cost\n"
        "O1,2024-01-10,Mumbai,MYNTRA,,S1,Shirts,1000,800,0.2,1,800,144,65,350,20\n"
    ),
    "fact_returns": "return_id,order_id,return_date,return_reason,refund_amount,reverse_logistics_cost\nR1,O1,2024-01-15,Size issue,800,90\n",
    "fact_marketing_spend": "spend_date,channel,category,marketing_spend\n2024-01-01,MYNTRA,Shirts,1000\n",
}


def _write_csvs(path):
    for name, text in CSV_FILES.items():
        (path / f"{name}.csv").write_text(text)


def test_load_csv_dir_reads_all_five(spark, tmp_path):
    _write_csvs(tmp_path)
    t = load_csv_dir(spark, str(tmp_path))
    from marginlens.operators.marts import daily_pnl

    (r,) = rows(daily_pnl(t))
    assert r["returns_count"] == 1 and str(r["contribution_margin"]) == "-669.00"
    assert os.path.exists(tmp_path / "fact_orders.csv")


def test_materialized_csv_tables_give_the_same_results(spark, tmp_path):
    from marginlens.operators.marts import daily_pnl, store_performance
    from marginlens.sources.catalog import materialize

    _write_csvs(tmp_path)
    lazy = load_csv_dir(spark, str(tmp_path))
    stored = materialize(spark, lazy, str(tmp_path / "warehouse"), buckets=4)
    assert rows(daily_pnl(stored)) == rows(daily_pnl(lazy))
    assert sorted(map(str, rows(store_performance(stored)))) == sorted(map(str, rows(store_performance(lazy))))


def test_cents_refuse_doubles_and_wider_scales(spark):
    one = spark.range(1)
    assert one.select(cents(F.lit("8.29").cast("decimal(6,2)"))).first()[0] == 829
    for bad in (F.lit(8.29), F.lit("8.295").cast("decimal(6,3)"), F.lit("8")):
        with pytest.raises(Exception, match="scale 2 or less"):
            one.withColumn("x", bad).select(cents("x")).collect()


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same files through both readers: prices such as 19.99 and 8.29."""
    at = tmp_path_factory.mktemp("csv")
    prices = ["19.99", "8.29", "0.07", "1234.56"]
    orders = [
        order(f"O{i}", order_date=f"1998-03-{1 + i % 28:02d}", city=["Mumbai", "Delhi", None][i % 3], channel=["MYNTRA", "AJIO", "FLIPKART", "OFFLINE"][i % 4],
              category=["PROMO", "LARGE", "STANDARD"][i % 3], sku_id=f"S{i % 5}", selling_price=prices[i % 4], commission="8.29", cogs="4.35", store_id="ST1" if i % 4 == 3 else None)
        for i in range(100)
    ]
    returns = [ret(f"R{i}", f"O{i}", return_date=f"1998-03-{2 + i % 27:02d}", refund="19.99", rev_log="8.29") for i in range(0, 100, 7)]
    spend = [(dt.date(1998, 3, 1), "AJIO", "LARGE", D("19.99")), (dt.date(1998, 3, 2), "MYNTRA", None, D("8.29"))]
    skus = [("S1", "PROMO", D("19.99"), D("8.29"), D("0.07"))]
    stores = [("ST1", "Mumbai", "Standard", 1500, dt.date(2020, 1, 1))]
    t = make_tables(spark, orders=orders, returns=returns, skus=skus, stores=stores, spend=spend)
    write_csv_dir(t, str(at))
    return load_csv_dir(spark, str(at), typed=True), load_csv_dir(spark, str(at), typed=False)


@pytest.mark.parametrize("name", [s.name for s in registry.SPECS])
def test_inferred_files_give_the_same_results(both, name):
    typed, inferred = (sorted(map(str, rows(registry.apply(t, name)))) for t in both)
    assert typed == inferred


def test_inferred_amounts_are_exact(both):
    for t in both:
        got = {r["channel"]: r for r in rows(registry.apply(t, "channel_cm_per_spend"))}
        assert got["MYNTRA"]["gross_revenue"] == 499.75  # 25 x 19.99
