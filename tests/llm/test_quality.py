from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from marginlens.llm import entry, quality as q

SF = "/root/testdata/sf0.1"


def test_pool_is_isotonic_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    v = np.sort(rng.normal(size=200))
    y = (rng.random(200) < 1 / (1 + np.exp(-3 * v))).astype(float)
    knots, values = q.pool([(a, b, 1.0) for a, b in zip(v, y)])
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    assert 0 < values[0] and values[-1] < 1


def test_held_out_accuracy_over_the_whole_table(spark):
    rows = entry.op10_quality(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = got["score"].rank()
    good, bad = got["quality"] == 1, got["quality"] == 0
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / bad.sum()
    assert auc > 0.98
    assert ((got["predicted"] == 1) == good).mean() > 0.97
    assert (got["predicted"][good] == 1).mean() > 0.99  # clean documents stay
    assert ((got["predicted"] == 1) == (got["score"] >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))


def test_summed_normal_equations_are_the_whole_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(q.STATISTICS)))
    n, s = rng.integers(1, 3, 300).astype(float), np.zeros(300)
    s[x[:, 0] > 0] = n[x[:, 0] > 0]
    model = q.Model(np.zeros(15), np.ones(15), rng.normal(size=(15, 20)), rng.uniform(0, 6, 20), np.zeros(21), np.zeros(0), np.zeros(0))
    rows = spark.createDataFrame([(r.tolist(), float(a), float(b)) for r, a, b in zip(x, n, s)], "x array<double>, n double, s double").repartition(5)
    z = model.features(x)
    lam = np.full(21, 2.0)
    lam[0] = 1e-6
    want = np.linalg.solve((z * n[:, None]).T @ z + np.diag(lam), z.T @ s)
    assert np.allclose(q._solve(rows, model, 2.0), want)


def test_edge_rows(spark, make_docs):
    docs = make_docs([(i, "good words in a fine order here") for i in range(1, 40)] + [(i, "### $$$ %%% &&&" * 3) for i in range(40, 80)] + [(None, "x"), (90, None), (91, ""), (91, ""), (92, "z " * 100_000)])
    docs = docs.selectExpr("*", "1 as score", "2 as x", "3 as quality", "4 as n")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(1, 80)] + [(1, None), (None, 1), (2, 1), (999, 0)], "doc_id long, quality int").selectExpr("*", "'t' as text")
    rows = q.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert min(by[i] for i in range(1, 40)) > 0.7 and max(by[i] for i in range(40, 80)) < 0.3
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert set(range(1, 40)) <= left and not left & set(range(40, 80))
    assert {r["score"] for r in q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert q.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert q.quality_scores(docs.limit(0), labels).count() == 0
    one = labels.where(F.col("quality") == 1)
    assert all(r["score"] > 0.5 for r in q.quality_scores(docs, one).collect())
