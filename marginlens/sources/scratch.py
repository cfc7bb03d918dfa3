"""Tables written on the way to a result, under the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .catalog import note_written, storage_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; ``catalog.release`` removes it."""
    path = f"{storage_root(spark)}/marginlens/{name}-{uuid.uuid4().hex[:12]}"
    note_written(spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: evaluated once, and safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
