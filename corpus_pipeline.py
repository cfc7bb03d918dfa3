"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

1. ``quality``: documents the classifier rejects go.
2. ``near_duplicates``: one document of each SimHash component stays.
3. ``decontamination``: documents that contain a benchmark item go.
4. ``secrets``: found secrets are replaced in the text by their kind, and
   n_chars follows; no document goes.
5. ``tokens``: the texts as byte-level BPE ids, with the digest of what they
   decode to.

Every stage but the last returns the columns of its input, extra ones with any
name included; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.llm import bpe_codec, decontaminate, entry, quality, secret_scan, simhash_cover
from marginlens.llm.common import scratch, shared_dir, table

# No SQL: the stages hold a fitted model, a compressor and a tokenizer.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of at least ``entry.KEEP_FROM``. Null text is scored as
    empty; rows with a null id are scored and not learned from; repeated rows go
    or stay together. Without labels all rows stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), entry.KEEP_FROM)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per SimHash component: the one with its smallest id. Null, empty
    and wordless texts are one component. Of rows that repeat id and fingerprint
    one stays; if they differ in other columns, which one is not defined. Of rows
    with null ids that reach no other id, one per component stays."""
    return simhash_cover.keep_one(docs, entry.SHINGLE, entry.RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark`` and no near copy of one. Null and
    empty texts stay, as do rows with a null id; rows that repeat a contaminated
    row's id go with it. An empty ``benchmark`` drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in the text replaced by their kind; n_chars follows
    where the text changed. Null and empty texts stay as they are."""
    kind = docs.schema["n_chars"].dataType
    clean = docs.withColumn("__clean", secret_scan.redacted(F.col("text")))
    size = F.when(F.col("__clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__clean").cast(kind))
    return clean.withColumn("n_chars", size).withColumn("text", F.col("__clean")).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of all rows. Null and empty texts have no ids; null ids
    and repeated rows are rows like others."""
    return bpe_codec.encoded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # what the stage saved on its way
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
