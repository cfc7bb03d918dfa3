"""Mart views (Q01-Q07) on hand-made rows: the edge cases of FIXTURES.md section 3."""

from decimal import Decimal

from conftest import D, make_tables, order, ret, rows

from marginlens.operators import marts


def _by(rs, *keys):
    return {tuple(r[k] for k in keys): r for r in rs}


def test_two_returns_one_order_counts_revenue_once(spark):
    t = make_tables(spark, orders=[order("O1")], returns=[ret("R1", "O1"), ret("R2", "O1")])
    (r,) = rows(marts.daily_pnl(t))
    assert r["order_count"] == 1
    assert r["gross_revenue"] == D(800)
    assert r["returns_count"] == 2
    assert r["refund_value"] == D(1600)
    assert r["net_revenue"] == D(-800)
    (rr,) = rows(marts.return_rate(t))
    assert (rr["total_orders"], rr["returned_orders"], rr["return_rate"]) == (1, 2, 2.0)


def test_return_without_order_is_not_in_daily_pnl(spark):
    t = make_tables(spark, orders=[order("O1")], returns=[ret("R9", "O404")])
    (r,) = rows(marts.daily_pnl(t))
    assert r["returns_count"] == 0 and r["refund_value"] == 0


def test_full_refund_gives_zero_margin_fraction_not_error(spark):
    t = make_tables(spark, orders=[order("O1")], returns=[ret("R1", "O1", refund=800)])
    (r,) = rows(marts.daily_pnl(t))
    assert r["net_revenue"] == 0
    assert r["contribution_margin_pct"] == 0.0
    # 800 - 800 - 100 - 300 - 20 - 50 - 90
    assert r["contribution_margin"] == D(-560)


def test_null_city_finds_no_return(spark):
    t = make_tables(spark, orders=[order("O1", city=None)], returns=[ret("R1", "O1")])
    (r,) = rows(marts.daily_pnl(t))
    assert r["city"] is None
    assert r["returns_count"] == 0 and r["refund_value"] == 0


def test_discount_value_is_negative_for_a_discount(spark):
    t = make_tables(spark, orders=[order("O1", mrp=1000, selling_price=800, qty=2)])
    (r,) = rows(marts.daily_pnl(t))
    assert r["gross_mrp"] == D(2000) and r["gross_revenue"] == D(1600)
    assert r["discount_value"] == D(-400)


def test_price_parity_spread_edge_cases(spark):
    t = make_tables(
        spark,
        orders=[
            order("a1", sku_id="P1", channel="MYNTRA", selling_price=500),
            order("b1", sku_id="P2", channel="OFFLINE", selling_price=500),
            order("c1", sku_id="P3", channel="D2C_WEB", selling_price=500),
            order("d1", sku_id="P4", channel="MYNTRA", selling_price=0),
            order("d2", sku_id="P4", channel="FLIPKART", selling_price=600),
            order("e1", sku_id="P5", channel="AJIO", selling_price=700),
            order("e2", sku_id="P5", channel="D2C_APP", selling_price=400),
            order("e3", sku_id="P5", channel="D2C_APP", selling_price=500),
        ],
    )
    got = _by(rows(marts.price_parity(t)), "sku_id")
    assert got[("P1",)]["price_spread"] == 0.0
    assert got[("P2",)]["price_spread"] == -99999.0
    assert got[("P3",)]["price_spread"] == -99999.0
    assert got[("P4",)]["price_spread"] is None
    assert got[("P5",)]["asp_d2c_app"] == 450.0
    assert got[("P5",)]["price_spread"] == 700.0 - 450.0
    assert got[("P1",)]["asp_d2c_web"] is None


def test_sku_in_two_categories_meets_its_return_in_both_rows(spark):
    t = make_tables(
        spark,
        orders=[order("O1", sku_id="X", category="A"), order("O2", sku_id="X", category="B")],
        returns=[ret("R1", "O1")],
    )
    got = _by(rows(marts.sku_profitability(t)), "sku_id", "category")
    assert got[("X", "A")]["returns"] == 1 and got[("X", "B")]["returns"] == 1
    # return rate is returns over units (not over orders)
    assert got[("X", "A")]["return_rate"] == 1.0
    r = got[("X", "A")]
    assert r["gross_margin"] == D(800 - 100 - 300 - 20 - 50)
    assert r["true_margin_post_returns"] == r["gross_margin"] - D(800) - D(90)


def test_marketing_efficiency_spend_cases(spark):
    import datetime as dt

    def spend(ch, cat, amount):
        return (dt.date(2024, 1, 1), ch, cat, Decimal(str(amount)))

    t = make_tables(
        spark,
        orders=[
            order("O1", category="Shirts", channel="MYNTRA"),
            order("O2", category="Jeans", channel="AJIO"),
            order("O3", category="Jackets", channel="FLIPKART"),
        ],
        spend=[spend("MYNTRA", "Shirts", 400), spend("FLIPKART", "Jackets", 0), spend("D2C_APP", "Trousers", 50)],
    )
    got = _by(rows(marts.marketing_efficiency(t)), "category", "channel")
    assert set(got) == {("Shirts", "MYNTRA"), ("Jeans", "AJIO"), ("Jackets", "FLIPKART")}
    assert got[("Shirts", "MYNTRA")]["romi"] == 800 / 400
    assert got[("Jeans", "AJIO")]["marketing_spend"] is None
    assert got[("Jeans", "AJIO")]["romi"] is None and got[("Jeans", "AJIO")]["net_contribution"] is None
    assert got[("Jackets", "FLIPKART")]["romi"] == 0.0


def test_store_without_orders_is_kept(spark):
    import datetime as dt

    stores = [
        ("ST1", "Mumbai", "Standard", 2000, dt.date(2023, 1, 1)),
        ("ST2", "Delhi", "Flagship", 10000, dt.date(2023, 1, 1)),
    ]
    t = make_tables(
        spark,
        stores=stores,
        orders=[order("O1", channel="OFFLINE", store_id="ST1", qty=2), order("O2", channel="OFFLINE", store_id="ST1")],
    )
    got = _by(rows(marts.store_performance(t)), "store_id")
    assert got[("ST1",)]["orders"] == 2 and got[("ST1",)]["units"] == 3
    assert got[("ST1",)]["revenue_per_sqft"] == 2400 / 2000
    assert got[("ST2",)]["orders"] == 0
    assert got[("ST2",)]["units"] is None and got[("ST2",)]["gross_revenue"] is None
    assert got[("ST2",)]["revenue_per_sqft"] is None


def test_returns_analytics_days_to_return(spark):
    t = make_tables(
        spark,
        orders=[order("O1", order_date="2024-01-10"), order("O2", order_date="2024-01-10")],
        returns=[ret("R1", "O1", return_date="2024-01-12"), ret("R2", "O2", return_date="2024-01-15")],
    )
    (r,) = rows(marts.returns_analytics(t))
    assert r["return_count"] == 2 and r["avg_days_to_return"] == 3.5


def test_repeated_order_id_keeps_join_multiplicity(spark):
    # order id O1 twice in orders and twice in returns: a row-level join
    # gives 4 pairs; the pre-aggregated joins must give the same sums.
    t = make_tables(
        spark,
        orders=[order("O1"), order("O1")],
        returns=[ret("R1", "O1", refund=100, rev_log=10), ret("R2", "O1", refund=200, rev_log=20)],
    )
    (p,) = rows(marts.daily_pnl(t))
    assert p["order_count"] == 1 and p["gross_revenue"] == D(1600)
    assert p["returns_count"] == 4 and p["refund_value"] == D(600)
    (a,) = rows(marts.returns_analytics(t))
    assert a["return_count"] == 4 and a["total_refund"] == D(600) and a["total_reverse_logistics"] == D(60)
    (rr,) = rows(marts.return_rate(t))
    assert (rr["total_orders"], rr["returned_orders"]) == (1, 2)
    (s,) = rows(marts.sku_profitability(t))
    assert s["returns"] == 4


def test_spend_under_null_key_meets_no_sales(spark):
    import datetime as dt

    t = make_tables(
        spark,
        orders=[order("O1", category=None, channel="MYNTRA")],
        spend=[(dt.date(2024, 1, 1), "MYNTRA", None, Decimal("500"))],
    )
    (r,) = rows(marts.marketing_efficiency(t))
    assert r["category"] is None and r["marketing_spend"] is None and r["romi"] is None
