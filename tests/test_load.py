"""The load step: bucket sizes, files, failures and removal."""

from __future__ import annotations

import os

import pytest
from conftest import SF_SMALL, make_tables, order, ret
from pyspark.sql import functions as F

from marginlens.sources import catalog, testdata


def test_bucket_count_follows_the_bytes(spark):
    least = spark.sparkContext.defaultParallelism
    assert catalog.bucket_count(spark, 0) == least
    assert catalog.bucket_count(spark, 100 * 2**30) == max(100, least)
    assert catalog.bucket_count(spark, 100 * 10**12) == 93133  # 100 TB: about a GiB each
    with pytest.raises(ValueError, match="maxBuckets"):
        catalog.bucket_count(spark, 200 * 10**12)
    spark.conf.set("marginlens.buckets", "7")
    try:
        assert catalog.bucket_count(spark, 10**15) == 7
    finally:
        spark.conf.unset("marginlens.buckets")


def test_one_file_for_a_bucket_and_removal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_loaded", {})
    monkeypatch.setattr(catalog, "_written", {})
    monkeypatch.setattr(catalog, "storage_root", lambda spark: str(tmp_path))
    buckets = catalog.bucket_count(spark, 0)
    t = catalog.load_test_tables(spark, SF_SMALL)
    assert t.fact_returns.count() > 0
    (root,) = (tmp_path / "marginlens").iterdir()
    for name in ("order_lines", "fact_returns"):
        files = [f for f in os.listdir(root / name) if f.startswith("part-")]
        assert 0 < len(files) <= buckets
        assert len({f.rpartition("_")[2] for f in files}) == len(files)  # one per bucket number
    catalog.release(spark)
    assert not list(root.iterdir()) and not catalog._loaded


def test_a_failing_write_raises(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_loaded", {})
    monkeypatch.setattr(testdata, "returns_from_lines", lambda lines: lines.selectExpr("raise_error('full') AS order_id", "order_date AS return_date"))
    monkeypatch.setattr(catalog, "storage_root", lambda spark: str(tmp_path))
    with pytest.raises(Exception, match="full"):
        catalog.load_test_tables(spark, SF_SMALL)
    assert not catalog._loaded


def test_materialize_sizes_its_buckets(spark, tmp_path):
    t = make_tables(spark, orders=[order("O1")], returns=[ret("R1", "O1")])
    stored = catalog.materialize(spark, t, str(tmp_path / "w"))
    assert stored.fact_orders.count() == 1 and stored.fact_returns.count() == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        catalog.storage_root(Session())


def test_buckets_follow_the_rows(spark):
    """216 million lines lie in 4 GB of source files; a task must not hold a twelfth of them."""
    least = spark.sparkContext.defaultParallelism
    assert catalog.fact_buckets(spark, 10**6, 1000 * catalog.LINE_BYTES) == least
    some, more = (catalog.fact_buckets(spark, n * 18, n * catalog.LINE_BYTES) for n in (36_000_000, 216_000_000))
    assert max(36_000_000 / some, 216_000_000 / more) < 600_000
    assert catalog.fact_buckets(spark, 100 * 10**12, 10**15) == 100_000  # as many as Spark allows, still one per GiB
    assert catalog.fact_buckets(spark, 50 * 2**30, None) == max(50, least)
    spark.conf.set("marginlens.buckets", "7")
    try:
        assert catalog.fact_buckets(spark, 10**9, 10**15) == 7
    finally:
        spark.conf.unset("marginlens.buckets")


def test_a_bucket_stays_small_as_the_rows_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_loaded", {})
    monkeypatch.setattr(catalog, "_written", {})
    monkeypatch.setattr(catalog, "storage_root", lambda spark: str(tmp_path))
    monkeypatch.setattr(catalog, "BUCKET_ROW_BYTES", 100 * catalog.LINE_BYTES)
    t = catalog.load_test_tables(spark, SF_SMALL)
    (root,) = (tmp_path / "marginlens").iterdir()
    lines = spark.read.parquet(str(root / "order_lines")).groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert lines[0] <= 200 and lines[1] == t.fact_orders.count() > 5000
    names = sorted(f.rpartition("_")[2] for f in os.listdir(root / "order_lines") if f.startswith("part-"))
    assert len(set(names)) == len(names) > 50
    catalog.release(spark)


def test_lines_are_dealt_before_their_columns_are_derived(spark):
    dealt = testdata.order_lines(spark, SF_SMALL, 7)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("RepartitionByExpression")
    for name in ("selling_price", "gross_revenue", "commission", "packaging_cost", "store_id", "city", "channel"):
        assert f" AS {name}#" in above and f" AS {name}#" not in below
    assert dealt.where(F.spark_partition_id() != F.pmod(F.hash("order_id"), F.lit(7))).count() == 0
    plain = testdata.order_lines(spark, SF_SMALL)
    assert dealt.schema == plain.schema
    assert dealt.exceptAll(plain).count() == 0 and plain.exceptAll(dealt).count() == 0
