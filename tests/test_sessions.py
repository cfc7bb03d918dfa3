"""Gap sessions against a plain walk along each key, with keys split over slices."""

from __future__ import annotations

import datetime as dt
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from marginlens.operators import sessions

START = dt.datetime(2024, 3, 30, 22)  # clocks change within in some time zones
SCHEMA = "user_id long, ts timestamp_ntz, event_type string, value double"


def by_hand(rows, gap):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, own in groupby(sorted(rows, key=lambda r: (key(r), r[1] is not None, r[1] or START)), key):
        number, last = 0, None
        for user, ts, kind, value in own:
            if ts is not None and (last is None or ts - last > gap):
                number += 1
            last = ts
            out.setdefault((user, number), []).append((ts, kind, value))
    return out


@pytest.fixture(params=[1, 9])
def slices(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("gap", [60, 3600, 10**6])
def test_sessions(spark, slices, gap):
    rng = random.Random(gap)
    users = [7] * 8 + [1, 2, None]
    steps = [START + dt.timedelta(seconds=60 * rng.randrange(400)) for _ in range(300)] + [None] * 12
    rows = [(rng.choice(users), rng.choice(steps), rng.choice(["error", "view", None]), rng.choice([0.25, 1.1, None])) for _ in range(400)]
    rows += rows[:20]
    got = {(r["user_id"], r["session_no"]): r for r in sessions.event_sessions(spark.createDataFrame(rows, SCHEMA), gap).collect()}
    want = by_hand(rows, dt.timedelta(seconds=gap))
    assert set(got) == set(want)
    for at, own in want.items():
        times = [t for t, _, _ in own if t]
        values = [v for _, _, v in own if v is not None]
        r = got[at]
        assert (r["started"], r["ended"]) == (min(times, default=None), max(times, default=None))
        assert (r["n_events"], r["n_errors"]) == (len(own), sum(k == "error" for _, k, _ in own))
        assert r["value"] == (pytest.approx(sum(values)) if values else None)


def test_a_hot_user_runs_in_several_tasks(spark, slices):
    rows = [(7, START + dt.timedelta(minutes=i), "view", 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    numbered = sessions.numbered(df, ["user_id"], "ts", 3600)
    assert numbered.agg(F.min("session_no"), F.max("session_no"), F.count("*")).first()[:] == (1, 1, 900)
    if slices > 1:
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan
        cut = sessions.sliced(df, ["user_id"], [F.col("ts").asc_nulls_first()], lambda d: sessions.saved(d, "t"))
        assert cut.select("__slice").distinct().count() > 4


def test_empty(spark):
    assert sessions.event_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
