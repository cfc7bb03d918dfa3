"""Restatement of the published P&L: equals a full rebuild, touches only what changed."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from conftest import SF_SMALL, make_tables, order, ret, rows
from pyspark.sql import functions as F

from marginlens.operators import marts, restate
from marginlens.sources.catalog import load_test_tables


def _facts(spark, orders, returns):
    return make_tables(spark, orders=orders, returns=returns)


OLD = [order(f"O{i}", order_date=d) for i, d in enumerate(["2024-01-10", "2024-01-10", "2024-02-03", "2024-03-31", "2024-04-01", None])]
OLD_RETURNS = [ret("R0", "O0"), ret("R3", "O3", return_date="2024-04-20")]


def _files(path):
    out = {}
    for at, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                full = os.path.join(at, n)
                out[os.path.relpath(full, path)] = os.stat(full).st_mtime_ns
    return out


def _sorted(df, pnl):
    return sorted((tuple(r[c] for c in pnl.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("grain", restate.GRAINS)
def test_late_returns_changed_and_removed_lines(spark, tmp_path, grain):
    path = str(tmp_path / "pnl")
    restate.publish(_facts(spark, OLD, OLD_RETURNS), path, grain)
    before = _files(path)
    # O1 costs more, O2 is gone (its period is empty now), O6 is new, O5 (no date) is returned late, and so is an unknown order.
    changed_old = [OLD[1], OLD[2]]
    changed_new = [order("O1", order_date="2024-01-10", cogs=450), order("O6", order_date="2024-04-01")]
    late = [ret("R5", "O5"), ret("R9", "unknown"), ret("R8", None)]
    now = _facts(spark, [OLD[0], OLD[3], OLD[4], OLD[5], *changed_new], [*OLD_RETURNS, *late])
    change = _facts(spark, changed_old + changed_new, late)
    periods = restate.restate(now, path, change.fact_returns, change.fact_orders, grain)
    january = dt.date(2024, 1, 10 if grain == "day" else 1)
    february = dt.date(2024, 2, 3 if grain == "day" else 1)
    assert periods == [None, january, february, dt.date(2024, 4, 1)]
    pnl = marts.daily_pnl(now)
    want = _sorted(pnl, pnl)
    assert _sorted(restate.published(spark, path, pnl), pnl) == want
    after = _files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in same} == {f"period=2024-03-{'31' if grain == 'day' else '01'}"}
    assert not any(f"period={february}" in f for f in after)
    # A second run of the same change writes the same table.
    assert restate.restate(now, path, change.fact_returns, change.fact_orders, grain) == periods
    assert _sorted(restate.published(spark, path, pnl), pnl) == want


def test_nothing_changed_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "pnl")
    t = _facts(spark, OLD, OLD_RETURNS)
    restate.publish(t, path)
    before = _files(path)
    assert restate.restate(t, path, t.fact_returns.limit(0), t.fact_orders.limit(0)) == []
    assert _files(path) == before


def test_the_scan_reads_only_touched_dates(spark):
    t = load_test_tables(spark, SF_SMALL)
    days = [dt.date(1998, 3, 1), dt.date(1998, 7, 1)]
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for grain, ends in (("month", ["1998-03-31", "1998-07-31"]), ("day", [str(d) for d in days])):
            df = marts.daily_pnl_of(t, t.fact_orders.where(restate.in_periods(days, grain)))
            plan = df._jdf.queryExecution().executedPlan().toString()
            for a, b in zip(days, ends):
                ranged = f"And(GreaterThanOrEqual(order_date,{a}),LessThanOrEqual(order_date,{b}))"
                assert ranged in plan or f"EqualTo(order_date,{a})" in plan
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)


def test_restated_rows_are_those_of_touched_months(spark):
    t = load_test_tables(spark, SF_SMALL)
    got = restate.restated_daily_pnl(t)
    pnl = marts.daily_pnl(t)
    assert _sorted(got, pnl) == _sorted(pnl, pnl)
    months = {r["m"] for r in got.where("restated").select(F.trunc("order_date", "month").alias("m")).distinct().collect()}
    assert 1 <= len(months) <= 3
    assert rows(got.where("not restated").agg(F.count("*").alias("n")))[0]["n"] > 0


def test_unknown_grain_is_refused():
    with pytest.raises(ValueError):
        restate.period_of("week")
