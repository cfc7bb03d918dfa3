"""Helpers shared by the operators: tables, saved intermediate tables, folds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that
    Python workers find it wherever the application was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    at = os.path.join(tempfile.mkdtemp(prefix="marginlens-"), "marginlens.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "marginlens")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the
    session. Only where it is unset and the master is local (tests), a
    temporary folder is made and remembered for the session."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marginlens-llm-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts
    the lineage, survives lost executors, and lets AQE see plain scans."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _saved.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


_saved: list[str] = []


def mark() -> int:
    """The place ``forget`` goes back to."""
    return len(_saved)


def forget(spark: SparkSession, since: int, keep: list[DataFrame | None]) -> None:
    """Remove the tables saved since ``mark``, but those of ``keep``: for
    steps whose results are written and don't read them again."""
    held = {df.saved_at for df in keep if df is not None}
    for path in [p for p in _saved[since:] if p not in held]:
        _delete(spark, path)
        _saved.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables saved within, at its end: for callers that have
    written their result by then. Results not yet written still need them."""
    mark = len(_saved)
    try:
        yield
    finally:
        for path in _saved[mark:]:
            _delete(spark, path)
        del _saved[mark:]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch; long batches are
    handed over in slices, so a task holds few texts as Python objects."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes (a
    longer row is a part of its own)."""
    wide = -(-batch.nbytes // max(batch.num_rows, 1)) * min(rows, batch.num_rows) > size
    if not wide or "text" not in batch.schema.names:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (held + n > size or i - at == rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    """True where the fold is ``remainder``; a null id is not held out, and it
    is not learned from either (see ``learned``)."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def learned(doc_id: Column, folds: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, folds) != remainder, F.lit(False))
