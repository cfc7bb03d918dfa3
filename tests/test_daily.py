"""Daily report (Q15-Q21, Q33, Q34) on hand-made rows."""

import datetime as dt
import json

from conftest import D, make_tables, order, ret, rows

from marginlens.operators import daily

TARGET = "2024-01-10"


def _window_orders():
    # One order per day from 01-03 to 01-10, except 01-05: 7 of 8 days present.
    days = [f"2024-01-{d:02d}" for d in range(3, 11) if d != 5]
    out = [order(f"O{d}", order_date=d, category="Shirts", selling_price=100) for d in days]
    # A category idle in the window (sold only long before it).
    out.append(order("OLD", order_date="2023-12-01", category="Jeans", selling_price=100))
    return out


def test_window_has_present_days_only(spark):
    t = make_tables(spark, orders=_window_orders())
    got = rows(daily.daily_kpi_window(t, TARGET))
    assert [r["order_date"] for r in got] == [dt.date(2024, 1, d) for d in (3, 4, 6, 7, 8, 9, 10)]


def test_baseline_mean_is_over_present_days(spark):
    t = make_tables(spark, orders=_window_orders())
    (r,) = rows(daily.baseline_compare(t, TARGET))
    assert r["date"] == dt.date(2024, 1, 10)
    assert r["revenue_today"] == D(100)
    assert r["revenue_7d_avg"] == 100.0  # 600 / 6 present days
    assert r["revenue_change_pct"] == 0.0
    assert r["orders_today"] == 1 and r["orders_7d_avg"] == 1.0


def test_category_movers_divide_by_seven_and_keep_idle_category(spark):
    t = make_tables(spark, orders=_window_orders())
    got = {r["category"]: r for r in rows(daily.category_movers(t, TARGET))}
    assert got["Shirts"]["today_rev"] == D(100)
    assert got["Shirts"]["avg_rev"] == 600 / 7.0
    assert abs(got["Shirts"]["delta_pct"] - (100 - 600 / 7.0) / (600 / 7.0) * 100) < 1e-12
    assert got["Jeans"]["today_rev"] == 0 and got["Jeans"]["avg_rev"] == 0.0
    assert got["Jeans"]["delta_pct"] is None


def test_empty_window_gives_no_rows(spark):
    t = make_tables(spark, orders=_window_orders())
    assert rows(daily.baseline_compare(t, "2020-01-01")) == []
    assert rows(daily.daily_kpi_window(t, "2020-01-01")) == []


def test_default_target_is_last_order_date(spark):
    t = make_tables(spark, orders=_window_orders())
    (r,) = rows(daily.max_order_date(t))
    assert r["max_order_date"] == dt.date(2024, 1, 10)
    assert rows(daily.baseline_compare(t)) == rows(daily.baseline_compare(t, TARGET))


def test_reasons_on_day_ties_broken_by_name(spark):
    rs = []
    for i, reason in enumerate(["Size issue", "Size issue", "Late delivery", "Late delivery", "Colour not as expected", "Changed mind"]):
        rs.append(ret(f"R{i}", f"O{i}", return_date=TARGET, reason=reason))
    rs.append(ret("RX", "OX", return_date="2024-01-09", reason="Colour not as expected"))
    t = make_tables(spark, orders=_window_orders(), returns=rs)
    got = [(r["return_reason"], r["n"]) for r in rows(daily.return_reasons_on_day(t, TARGET))]
    assert got == [("Late delivery", 2), ("Size issue", 2), ("Changed mind", 1)]


def test_refunds_are_booked_on_the_order_date(spark):
    orders = _window_orders()
    t = make_tables(spark, orders=orders, returns=[ret("R1", "O2024-01-03", return_date="2024-01-10", refund=100, rev_log=10)])
    got = {r["order_date"]: r for r in rows(daily.daily_kpi_window(t, TARGET))}
    assert got[dt.date(2024, 1, 3)]["refunds"] == D(100)
    assert got[dt.date(2024, 1, 10)]["refunds"] == 0


def test_snapshot_return_cost_null_when_one_side_null(spark):
    orders = [order("O1", order_date=TARGET)]
    t = make_tables(spark, orders=orders, returns=[ret("R1", "O1", refund=100, rev_log=None)])
    (r,) = rows(daily.daily_kpi_snapshot(t, TARGET))
    # SUM(refund) + SUM(reverse) is NULL -> treated as 0 return cost
    assert r["cm"] == D(800 - 100 - 300 - 20 - 50)
    (w,) = rows(daily.daily_kpi_window(t, TARGET))
    assert w["contribution_margin"] == D(800 - 100 - 100 - 300 - 20 - 50)


def test_insights_payload_matches_its_parts(spark):
    rs = [ret("R1", "O2024-01-10", return_date=TARGET, reason="Size issue")]
    t = make_tables(spark, orders=_window_orders(), returns=rs)
    (p,) = rows(daily.insights_payload(t, TARGET))
    assert p["date"] == TARGET
    assert p["revenue_today_lakhs"] == 0.0  # 100 rupees
    assert p["orders_today"] == 1 and p["orders_7d_avg"] == 1
    movers = {m["category"]: m for m in p["category_movers"]}
    assert set(movers) == {"Shirts", "Jeans"} and movers["Jeans"]["delta_pct"] is None
    assert p["top_return_reasons_today"] == [{"return_reason": "Size issue", "n": 1}]
    payload = json.loads(p["payload_json"])
    assert payload["date"] == TARGET and payload["orders_today"] == 1
    assert [m["category"] for m in payload["category_movers"]] == ["Jeans", "Shirts"]


def test_insights_payload_of_a_day_without_orders(spark):
    """The date is the day asked for; the numbers are the last day present."""
    orders = [order("A", order_date="2024-01-07", selling_price=250000), order("B", order_date="2023-06-01", category="Idle")]
    t = make_tables(spark, orders=orders, returns=[ret("R1", "A", return_date="2024-01-08")])
    (p,) = rows(daily.insights_payload(t, "2024-01-08"))
    payload = json.loads(p["payload_json"])
    assert p["date"] == payload["date"] == "2024-01-08"
    assert payload["revenue_today_lakhs"] == 2.5 and payload["revenue_7d_avg_lakhs"] is None
    idle = next(m for m in payload["category_movers"] if m["category"] == "Idle")
    assert idle == {"category": "Idle", "today_rev": 0.0, "avg_rev": 0.0, "delta_pct": None}
    assert payload["top_return_reasons_today"] == [{"return_reason": "Size issue", "n": 1}]
    assert rows(daily.insights_payload(t, "2025-01-01")) == []


def test_insights_fields_are_the_json(spark):
    rs = [ret(f"R{i}", "x", return_date=TARGET, reason=r) for i, r in enumerate(["Size issue", "Late delivery", "Late delivery"])]
    t = make_tables(spark, orders=_window_orders(), returns=rs)
    (p,) = rows(daily.insights_payload(t, TARGET))
    flat = {}

    def walk(at, value):
        if isinstance(value, list):
            for i, v in enumerate(value):
                walk(f"{at}[{i}]", v)
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(f"{at}.{k}" if at else k, v)
        else:
            flat[at] = value

    walk("", json.loads(p["payload_json"]))
    got = {r["path"]: r["num"] if r["text"] is None else r["text"] for r in rows(daily.insights_fields(t, TARGET))}
    assert got == flat


def test_reason_share_vs_prior_days(spark):
    rs = [
        ret("a", "x", return_date=TARGET, reason="Size issue"),
        ret("b", "x", return_date=TARGET, reason="Late delivery"),
        ret("c", "x", return_date="2024-01-05", reason="Size issue"),
        ret("d", "x", return_date="2024-01-04", reason="Size issue"),
        ret("e", "x", return_date="2024-01-04", reason="Changed mind"),
        ret("f", "x", return_date="2023-12-01", reason="Changed mind"),
    ]
    t = make_tables(spark, orders=_window_orders(), returns=rs)
    got = {r["return_reason"]: r for r in rows(daily.reason_share_vs_7d(t, TARGET))}
    assert got["Size issue"]["share_today"] == 0.5 and got["Size issue"]["share_prior"] == 2 / 3
    assert got["Late delivery"]["share_prior"] == 0.0
    assert got["Changed mind"]["n_today"] == 0 and got["Changed mind"]["n_prior"] == 1


def test_daily_anomalies_flags_a_spike(spark):
    base = [order(f"O{d}", order_date=f"2024-02-{d:02d}", selling_price=100 + d % 2) for d in range(1, 9)]
    spike = [order(f"S{i}", order_date="2024-02-09", selling_price=100) for i in range(20)]
    t = make_tables(spark, orders=base + spike)
    got = {(r["order_date"], r["kpi"]): r for r in rows(daily.daily_anomalies(t))}
    r = got[(dt.date(2024, 2, 9), "orders")]
    assert r["direction"] == "spike" and r["value"] == 20.0 and r["n_prior_days"] == 7
    assert (dt.date(2024, 2, 9), "revenue") in got
    # steady days are not flagged on orders (zero spread, no excess)
    assert not any(k[1] == "orders" and k[0] < dt.date(2024, 2, 9) for k in got)


def test_target_day_as_a_lazy_column(spark):
    from marginlens.operators.common import max_order_date_col

    t = make_tables(spark, orders=_window_orders())
    assert rows(daily.baseline_compare(t, max_order_date_col(t))) == rows(daily.baseline_compare(t, TARGET))
