"""Dashboard layer, load checks, insights and questions on hand-made rows."""

import datetime as dt

import pytest
from conftest import D, make_tables, order, ret, rows

from marginlens.operators import checks, dashboard, insights, questions
from marginlens.sources.catalog import register_views


def test_kpi_summary_counts_orphan_returns(spark):
    t = make_tables(
        spark,
        orders=[order("O1"), order("O2")],
        returns=[ret("R1", "O1", refund=800, rev_log=90), ret("R2", "GONE", refund=None, rev_log=10)],
    )
    (r,) = rows(dashboard.kpi_summary(t))
    assert r["revenue"] == D(1600) and r["orders"] == 2
    assert r["return_rate"] == 2 / 2 * 100.0
    # the orphan's refund is NULL, so its row is skipped by SUM(refund + reverse)
    costs = 2 * (100 + 300 + 20 + 50)
    assert r["cm_pct"] == (1600 - 890 - costs) / 1600 * 100.0


def test_top_reasons_limit_and_label(spark):
    reasons = ["Size issue"] * 3 + ["Quality not as expected"] * 2 + ["Colour not as expected"] * 2 + ["Late delivery", "Changed mind", "Other"]
    t = make_tables(spark, returns=[ret(f"R{i}", f"O{i}", reason=x) for i, x in enumerate(reasons)])
    got = rows(dashboard.top_return_reasons(t))
    assert [r["return_reason"] for r in got] == [
        "Size issue",
        "Colour not as expected",
        "Quality not as expected",
        "Changed mind",
        "Late delivery",
    ]
    assert got[1]["short_reason"] == "Colour ≠ expected"


def test_channel_cm_pct_rounding_and_sign(spark):
    t = make_tables(
        spark,
        orders=[order("O1", channel="AJIO"), order("O2", channel="D2C_APP", commission=0)],
        returns=[ret("R1", "O1", refund=800, rev_log=90), ret("R2", "O1", refund=0, rev_log=90)],
    )
    got = {r["channel"]: r for r in rows(dashboard.channel_cm_pct(t))}
    # AJIO: 800 - 800 - 100 - 300 - 20 - 50 - 180 = -650 -> -81.25 % -> -81.3
    assert got["AJIO"]["cm_pct"] == -81.3 and got["AJIO"]["sign"] == "Loss-making"
    # D2C_APP: 800 - 0 - 300 - 20 - 50 = 430 -> 53.75 % -> 53.8
    assert got["D2C_APP"]["cm_pct"] == 53.8 and got["D2C_APP"]["sign"] == "Profitable"


def test_monthly_label(spark):
    t = make_tables(spark, orders=[order("O1", order_date="2024-03-15"), order("O2", order_date="2024-03-01")])
    (r,) = rows(dashboard.monthly_revenue(t))
    assert r["month"] == dt.date(2024, 3, 1) and r["month_label"] == "Mar '24" and r["orders"] == 2
    assert r["revenue_l"] == 1600 / 1e5


def test_pk_violations_reports_duplicates_and_nulls(spark):
    skus = [("S1", "Shirts", D(1), D(1), D(1)), ("S1", "Shirts", D(1), D(1), D(1)), (None, "Jeans", D(1), D(1), D(1))]
    t = make_tables(spark, skus=skus, orders=[order("O1"), order("O1"), order("O2")])
    got = {(r["table_name"], r["key_value"]): r["n"] for r in rows(checks.pk_violations(t))}
    assert got == {("dim_sku", "S1"): 2, ("dim_sku", None): 1, ("fact_orders", "O1"): 2}


def test_table_counts_and_date_range(spark):
    t = make_tables(spark, orders=[order("O1", order_date="2024-01-02"), order("O2", order_date="2024-02-03")])
    counts = {r["table_name"]: r["row_count"] for r in rows(checks.table_counts(t))}
    assert counts == {"dim_sku": 0, "dim_store": 0, "fact_orders": 2, "fact_returns": 0, "fact_marketing_spend": 0}
    (r,) = rows(checks.order_date_range(t))
    assert (r["min_order_date"], r["max_order_date"]) == (dt.date(2024, 1, 2), dt.date(2024, 2, 3))


def test_channel_revenue_crore_rounding(spark):
    t = make_tables(spark, orders=[order("O1", channel="AJIO", selling_price=1234567)])
    (r,) = rows(checks.channel_revenue_cr(t))
    assert r["revenue_cr"] == 0.12


def test_bleeding_skus(spark):
    t = make_tables(
        spark,
        orders=[order("O1", sku_id="B"), order("O2", sku_id="G")],
        returns=[ret("R1", "O1", refund=800, rev_log=90)],
    )
    got = rows(insights.bleeding_skus(t))
    assert [r["sku_id"] for r in got] == ["B"]


def test_cost_waterfall_steps_add_up(spark):
    t = make_tables(spark, orders=[order("O1"), order("O2", channel="AJIO")], returns=[ret("R1", "O1")])
    by_channel = {}
    for r in rows(insights.cost_waterfall(t)):
        by_channel.setdefault(r["channel"], {})[r["step_no"]] = r["amount"]
    for steps in by_channel.values():
        assert sum(steps[i] for i in range(1, 8)) == steps[8]


def test_underpriced_skus_cheapest_channel(spark):
    t = make_tables(
        spark,
        orders=[
            order("a", sku_id="U", channel="MYNTRA", selling_price=500),
            order("b", sku_id="U", channel="AJIO", selling_price=500),
            order("c", sku_id="U", channel="D2C_APP", selling_price=900),
            order("d", sku_id="V", channel="D2C_APP", selling_price=900),
        ],
    )
    (r,) = rows(insights.underpriced_skus(t))
    assert r["sku_id"] == "U" and r["price_spread"] == 400.0 and r["cheapest_channel"] == "AJIO"


def test_cm_rolling_average_uses_calendar_days(spark):
    t = make_tables(
        spark,
        orders=[
            order("a", order_date="2024-01-01", channel="AJIO"),
            order("b", order_date="2024-01-07", channel="AJIO"),
            order("c", order_date="2024-01-08", channel="AJIO", selling_price=900),
        ],
    )
    got = {r["order_date"]: r for r in rows(insights.cm_rolling_7d(t))}
    # the 01-08 frame covers 01-02..01-08: two present days, 01-01 is out
    cm7, cm8 = got[dt.date(2024, 1, 7)]["contribution_margin"], got[dt.date(2024, 1, 8)]["contribution_margin"]
    assert got[dt.date(2024, 1, 8)]["cm_7d_avg"] == float(cm7 + cm8) / 2


def test_overview_filter_toggle(spark):
    t = make_tables(
        spark,
        orders=[
            order("a", channel="OFFLINE", city="Delhi"),
            order("b", channel="AJIO", city="Delhi"),
            order("c", channel="AJIO", city="Mumbai", qty=3),
        ],
    )
    (on,) = rows(insights.overview_filtered(t, mode="online", cities=["Delhi"]))
    (off,) = rows(insights.overview_filtered(t, mode="offline"))
    assert on["order_count"] == 1 and off["order_count"] == 1
    (all_,) = rows(insights.overview_filtered(t))
    assert all_["units_sold"] == 5


def test_questions(spark):
    t = make_tables(
        spark,
        orders=[
            order("O1", category="Jeans", channel="FLIPKART", order_date="2024-02-02"),
            order("O2", category="Shirts", channel="FLIPKART", order_date="2024-02-03", sku_id="S2", selling_price=900),
            order("O3", category="Shirts", channel="MYNTRA", order_date="2024-03-03"),
        ],
        returns=[ret("R1", "O1", reason="Size issue"), ret("R2", "O1", reason="Late delivery")],
    )
    (top,) = rows(questions.top_return_category(t, channel="FLIPKART"))
    assert top["category"] == "Jeans" and top["return_rate"] == 2.0
    (m,) = rows(questions.cm_category_channel_month(t, "Shirts", "FLIPKART", "2024-02-01"))
    assert m["contribution_margin"] == D(900 - 100 - 300 - 20 - 50)
    (none,) = rows(questions.cm_category_channel_month(t, "Shirts", "AJIO", "2024-02-01"))
    assert none["contribution_margin"] is None
    skus = rows(questions.top_skus_month(t, "2024-02-01", k=1))
    assert [s["sku_id"] for s in skus] == ["S2"]
    reasons = rows(questions.top_reasons_category(t, "Jeans"))
    assert [r["return_reason"] for r in reasons] == ["Late delivery", "Size issue"]
    assert rows(questions.return_rate_pair(t, "Jeans", "MYNTRA")) == []
    (low,) = rows(questions.lowest_commission_channel(t))
    assert low["channel"] in {"FLIPKART", "MYNTRA"}


def test_adhoc_sql_returns_its_whole_result(spark):
    t = make_tables(spark, orders=[order(f"O{i}") for i in range(50)])
    text = "SELECT order_id FROM fact_orders ORDER BY order_id"
    assert len(rows(questions.adhoc_sql(t, text))) == 50
    assert len(rows(questions.adhoc_sql(t, text, limit=20))) == 20
    (v,) = rows(questions.adhoc_sql(t, "SELECT SUM(order_count) AS n FROM v_daily_pnl"))
    assert v["n"] == 50


def test_adhoc_sql_with_qualified_names_keeps_the_session_views(spark):
    t = make_tables(spark, orders=[order("O1", sku_id="S1")], skus=[("S1", "Shirts", D(9), D(3), D(1))])
    spark.sql("SELECT 7 AS order_count").createOrReplaceTempView("v_daily_pnl")
    try:
        text = """SELECT p.order_count, s.sku_id, 'raw.dim_sku' AS said -- marts.v_daily_pnl
                  FROM MARTS.v_daily_pnl p JOIN raw . DIM_SKU s ON s.category = p.category"""
        assert rows(questions.adhoc_sql(t, text)) == [{"order_count": 1, "sku_id": "S1", "said": "raw.dim_sku"}]
        assert rows(questions.adhoc_sql(t, "SELECT order_count FROM v_daily_pnl")) == [{"order_count": 7}]
        with pytest.raises(ValueError, match="v_daily_pnl"):
            register_views(t)
        names = register_views(t, replace=True)
        assert rows(spark.sql("SELECT order_count FROM v_daily_pnl")) == [{"order_count": 1}]
    finally:
        for name in set(names) | {"v_daily_pnl"}:
            spark.catalog.dropTempView(name)


def test_adhoc_sql_binds_relations_only(spark, tmp_path):
    t = make_tables(spark, orders=[order("O1", sku_id="S1"), order("O2", sku_id="S1")], skus=[("S1", "Shirts", D(9), D(3), D(1))])
    views = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    run = lambda text: rows(questions.adhoc_sql(t, text))
    assert run("SELECT COUNT(*) AS dim_sku FROM raw.dim_sku") == [{"dim_sku": 1}]
    assert run("SELECT dim_sku.sku_id AS fact_orders FROM dim_sku") == [{"fact_orders": "S1"}]
    assert run("SELECT raw.dim_sku.sku_id FROM raw.dim_sku") == [{"sku_id": "S1"}]
    assert run("SELECT 'é😀' AS x, dim_sku.sku_id FROM raw.fact_orders JOIN raw.dim_sku USING (sku_id)") == [{"x": "é😀", "sku_id": "S1"}] * 2
    # A WITH clause's own name, subqueries, a table twice, a view over both.
    assert run("WITH dim_sku AS (SELECT 5 AS n) SELECT n FROM dim_sku") == [{"n": 5}]
    assert run("WITH a AS (SELECT sku_id FROM dim_sku) SELECT COUNT(*) AS n FROM fact_orders o WHERE o.sku_id IN (SELECT sku_id FROM a)") == [{"n": 2}]
    assert run("SELECT (SELECT COUNT(*) FROM raw.fact_orders) AS n FROM dim_sku WHERE EXISTS (SELECT 1 FROM fact_orders f WHERE f.sku_id = dim_sku.sku_id)") == [{"n": 2}]
    assert run("SELECT COUNT(*) AS n FROM fact_orders a JOIN fact_orders b ON a.sku_id = b.sku_id") == [{"n": 4}]
    assert run("SELECT COUNT(*) AS n FROM fact_orders TABLESAMPLE (100 PERCENT)") == [{"n": 2}]
    spark.sql("CREATE DATABASE IF NOT EXISTS mydb")
    spark.range(3).write.mode("overwrite").option("path", str(tmp_path / "own")).saveAsTable("mydb.dim_sku")
    try:
        assert len(run("SELECT * FROM mydb.dim_sku")) == 3
    finally:
        spark.sql("DROP TABLE mydb.dim_sku")
        spark.sql("DROP DATABASE mydb")
    with pytest.raises(Exception, match="no_such"):
        run("SELECT no_such FROM dim_sku")
    assert {v.name for v in spark.catalog.listTables() if v.isTemporary} == views
