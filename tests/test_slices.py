"""Running folds over slices against one window over each whole group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginlens.functions.slices import AT, SLICE, before, running, sliced


@pytest.fixture()
def save(tmp_path):
    def put(df):
        at = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(at)
        return df.sparkSession.read.parquet(at)

    return put


@pytest.fixture()
def rows(spark):
    rng = random.Random(3)
    keys = ["hot"] * 400 + [None] * 60 + [f"k{i}" for i in range(80)] * 2
    data = [(i, rng.choice(keys), rng.choice([1, 2, 2, 2, 5, None]), rng.choice([None, 3, 7, -2])) for i in range(900)]
    return spark.createDataFrame(data, "id long, k string, t int, v long")


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("slices", ["1", "7"])
def test_running_and_before_equal_a_whole_window(spark, save, rows, keys, slices):
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = sliced(rows, keys, [F.col("t").asc_nulls_first(), F.col("id").asc()], save)
        folds = {"s": ("sum", F.col("v")), "x": ("xor", F.coalesce("v", F.lit(0))), "m": ("max", F.col("v")), "z": ("last", F.col("v"))}
        got = {r["id"]: tuple(r[c] for c in folds) for r in running(cut, keys, folds).collect()}
        got_before = {r["id"]: tuple(r[c] for c in folds) for r in before(cut, keys, folds).collect()}
        spread = cut.where("k = 'hot'").select(SLICE).distinct().count()
        for k, v in old.items():
            spark.conf.set(k, v)
        order = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_first(), "id")

        def whole(last):
            w = order.rowsBetween(Window.unboundedPreceding, last)
            cols = F.coalesce(F.sum("v").over(w), F.lit(0)), F.bit_xor(F.coalesce("v", F.lit(0))).over(w), F.max("v").over(w), F.last("v", True).over(w)
            return {r[0]: tuple(r)[1:] for r in rows.select("id", *cols).collect()}

        assert got == whole(0)
        assert got_before == whole(-1)
        assert slices == "1" or spread > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_equal_rows_are_split_and_numbered_once(spark, save):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = sliced(spark.range(4000).select(F.lit(1).alias("k")), ["k"], [], save)
        got = running(cut, ["k"], {"n": ("sum", F.lit(1))})
        assert sorted(r["n"] for r in got.collect()) == list(range(1, 4001))
        assert cut.select(SLICE).distinct().count() > 1
        assert cut.select(AT).distinct().count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table(spark, save):
    cut = sliced(spark.range(0), [], [F.col("id").asc()], save)
    assert running(cut, [], {"n": ("sum", F.lit(1))}).count() == 0
