"""Each stage against the operator it calls and its own input."""

from __future__ import annotations

import hashlib
import os
import random

import pytest

import corpus_pipeline
from marginlens.llm import bpe_codec, decontaminate, entry, quality, secret_scan, simhash_cover
from marginlens.llm.common import saved, shared_dir, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
        assert [t for _, t in df.dtypes] == [t for _, t in steps[0].dtypes]


def test_quality(spark, steps):
    scores = quality.quality_scores(steps[0], table(spark, SF, "labels")).where(f"score >= {entry.KEEP_FROM}")
    assert ids(steps[1]) == ids(scores)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    gone = ids(steps[0]) - ids(steps[1])
    assert sum(labels.get(i) == 1 for i in gone) <= 0.01 * sum(q == 1 for q in labels.values())


def test_near_duplicates(steps):
    found = simhash_cover.near_duplicates(steps[1], entry.SHINGLE, entry.RADIUS).collect()
    assert ids(steps[2]) == {r["component_id"] for r in found}
    assert steps[2].count() == len({r["component_id"] for r in found})


def test_decontamination(spark, steps):
    bad = ids(decontaminate.contaminated(steps[2], table(spark, SF, "benchmark")))
    assert bad and ids(steps[3]) == ids(steps[2]) - bad


def test_secrets(steps):
    before = {r["doc_id"]: r for r in steps[3].collect()}
    after = {r["doc_id"]: r for r in steps[4].collect()}
    assert before.keys() == after.keys()
    novelty = secret_scan.Novelty()
    changed = 0
    for i, r in before.items():
        spans = secret_scan.scan(r["text"], novelty)
        assert after[i]["text"] == secret_scan.redact(r["text"], spans)
        assert after[i]["n_chars"] == (len(after[i]["text"]) if spans else r["n_chars"])
        assert not secret_scan.base_spans(after[i]["text"])
        changed += bool(spans)
    assert changed


def test_tokens(spark, steps):
    rows = steps[5].collect()
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    codec = bpe_codec.codec(bpe_codec.public_tokenizers.path(bpe_codec.RANKS))
    assert len(rows) == len(texts)
    for r in rows:
        data = codec.decode(r["ids"])
        assert data == texts[r["doc_id"]].encode()
        assert r["decoded_sha256"] == hashlib.sha256(data).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_run_and_empty_tables(spark, steps, tmp_path):
    assert corpus_pipeline.ORACLE_SQL is None
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    got = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r["doc_id"], r["ids_sha256"]) for r in steps[5].collect()}


def test_run_leaves_only_the_stages_tables(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert len(new) == 5 and all(x.startswith("pipeline-") for x in new)


def test_stages_with_nulls_repeats_and_clashing_columns(spark, make_docs, tmp_path):
    fine = "plain words stand here in a fine order and nothing else is said of them at all"
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(1, 60)]
    rows += [(i, "### $$$ %%% &&& " * (3 + i % 5)) for i in range(60, 100)]
    rows += [(1, rows[0][1]), (200, None), (201, ""), (None, f"{fine} without an id"), (None, None)]
    rows += [(300, "the token = 'abcdef0123456789' " + fine), (301, "long " * 60_000)]
    clash = [f"{i} AS {c}" for i, c in enumerate("score x n s quality ids fp fingerprint root component_id hash pos slots item_id spans base rule".split())]
    docs = make_docs(rows).selectExpr("*", *clash)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(1, 100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, rows[1][1]), (None, fine), (2, None), (3, "")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, saved(stage(spark, out, str(tmp_path)), f"edge-{name}")
        assert name == "tokens" or out.columns == docs.columns
        empty = stage(spark, before.limit(0), str(tmp_path))
        assert empty.count() == 0 and set(empty.columns) == set(out.columns)
    left = [r["doc_id"] for r in out.collect()]
    assert 2 not in left  # the benchmark's item
    assert left.count(1) == 1 and 3 in left and 300 in left
    assert not set(range(60, 100)) & set(left)


def test_secrets_stage_keeps_rows_without_a_text(spark, make_docs):
    docs = make_docs([(1, None), (None, ""), (3, "password = hunter2hunter2")]).selectExpr("doc_id", "text", "lang", "source", "coalesce(n_chars, 7L) AS n_chars")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secret_stage(spark, docs, "").collect()}
    assert got == {1: (None, 7), None: ("", 0), 3: ("[assign]", 8)}
