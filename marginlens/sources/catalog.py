"""Load, store and name the star schema.

``materialize`` is the load step (the reference's COPY INTO): it writes the
five tables once, so every query afterwards reads compact parquet instead of
re-running the derivation.

Layout chosen for the query mix:
  * fact_orders and fact_returns are bucketed by ``order_id`` into the same
    number of buckets. Every returns-to-orders join, and every distinct count
    of ``order_id``, then runs without a shuffle of the fact rows: both sides
    are already hash-partitioned on the key.
  * inside each bucket, rows are sorted by date (order_date / return_date),
    so parquet row-group min/max statistics let a date-window query (the daily
    report) skip most of each file.
  * the bucket count follows the rows: a bucket holds as many as one task sorts
    and groups in a few hundred MB; it can be set with ``marginlens.buckets``.

Files go under the shared folder the session names in ``spark.checkpoint.dir``
(the SparkContext checkpoint directory). Only a local session without one gets
a temporary folder, which is what tests do.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import testdata
from .tables import Tables

BUCKET_KEY = "order_id"
SORT_KEYS = {"fact_orders": "order_date", "fact_returns": "return_date"}

_lock = threading.Lock()
_loaded: dict[tuple[str, str], Tables] = {}
_written: dict[str, list[tuple[str | None, str]]] = {}  # by application: (table or None, path)


def storage_root(spark: SparkSession) -> str:
    """Shared folder for written tables: the session's checkpoint directory.
    A local session without one gets a temporary folder; on a cluster that
    would be each machine's own, so there it must be set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="marginlens-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


BUCKET_TARGET_BYTES = 1024 * 1024 * 1024  # a bucket is read by one task


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (file listing only; the
    ``binaryFile`` source does not read content unless asked for it)."""
    from pyspark.sql import functions as F

    size = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0]
    )
    return int(size or 0)


def bucket_count(spark: SparkSession, source_bytes: int | None) -> int:
    """Buckets of the facts: ``marginlens.buckets`` if set; else one per GiB of
    source, and at least the cluster's parallelism (every core scans); for a
    source of unknown size as many as shuffle partitions. More
    than Spark allows (``spark.sql.sources.bucketing.maxBuckets``) raises: a
    bucket is one task, and larger ones would not fit."""
    explicit = spark.conf.get("marginlens.buckets", None)
    if explicit:
        return int(explicit)
    if source_bytes is None:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = max(1, spark.sparkContext.defaultParallelism, -(-source_bytes // BUCKET_TARGET_BYTES))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    if wanted > most:
        raise ValueError(f"{source_bytes} bytes need {wanted} buckets, more than the {most} allowed; raise spark.sql.sources.bucketing.maxBuckets")
    return wanted


BUCKET_ROW_BYTES = 128 * 1024 * 1024  # a bucket's rows in memory; sorts, joins and distinct counts hold several times that
LINE_BYTES = 256  # an order line in memory: twenty columns of 8 bytes and seven texts
EXPANSION = 8  # bytes in memory for a byte of a source file, where its rows aren't counted


def fact_buckets(spark: SparkSession, source_bytes: int | None, row_bytes: int | None) -> int:
    """Buckets by what their rows take in a task's memory, which compressed
    source bytes don't tell: ``BUCKET_ROW_BYTES`` each, as far as Spark allows so
    many buckets, and never fewer than ``bucket_count``."""
    least = bucket_count(spark, source_bytes)
    if row_bytes is None or spark.conf.get("marginlens.buckets", None):
        return least
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(least, min(most, -(-row_bytes // BUCKET_ROW_BYTES)))


def planned_bytes(df: DataFrame) -> int | None:
    """The size Spark's planner takes for ``df`` (file sizes, for a plain
    scan); None where it knows none, as for rows from the driver."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 2**60 else None


def _write_bucketed(
    spark: SparkSession, df: DataFrame, path: str, table: str, sort_key: str, buckets: int, dealt: bool = False
) -> DataFrame:
    """Write ``df`` as a table bucketed by ``order_id`` and sorted by
    ``sort_key`` inside each bucket, one file per bucket; return it read back
    from the catalog. ``dealt``: its partitions are the buckets already."""
    (
        (df if dealt else df.repartition(buckets, BUCKET_KEY))
        .write.mode("overwrite")
        .bucketBy(buckets, BUCKET_KEY)
        .sortBy(sort_key)
        .option("path", path)
        .saveAsTable(table)
    )
    note_written(spark, path, table)
    return spark.table(table)


def _app(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", "") or str(id(spark))


def note_written(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Remember files, and the table over them, for ``release``."""
    _written.setdefault(_app(spark), []).append((table, path))


def materialize(spark: SparkSession, tables: Tables, root: str, buckets: int | None = None) -> Tables:
    """Write the five tables under ``root`` and return them read back.

    Facts are written as bucketed tables in the session catalog (bucketing is
    a catalog property, so it needs ``saveAsTable``); the data sits at an
    explicit path under ``root``. Dimensions and spend are plain parquet.
    """
    if not buckets:
        source_bytes = planned_bytes(tables.fact_orders)
        buckets = fact_buckets(spark, source_bytes, source_bytes and EXPANSION * source_bytes)
    token = uuid.uuid4().hex[:10]
    out = {}
    for name, df in tables.items():
        path = f"{root}/{name}"
        if name in SORT_KEYS:
            out[name] = _write_bucketed(spark, df, path, f"marginlens_{token}_{name}", SORT_KEYS[name], buckets)
        else:
            df.write.mode("overwrite").parquet(path)
            out[name] = spark.read.parquet(path)
    return Tables(**out)


def load_test_tables(spark: SparkSession, sf_dir: str, materialize_tables: bool = True) -> Tables:
    """Star schema over the driver's test tables at ``sf_dir``.

    With ``materialize_tables`` the mapping runs once per session and sf
    directory: the order lines (every fact_orders column plus the line
    attributes that decide returns) are written once, bucketed by order_id;
    fact_orders is that table without the helper columns, and fact_returns is
    derived from it, shuffled into the same buckets (a third of the rows) and
    written alongside. The dimensions and spend, single-table projections,
    stay views. Without it all tables stay lazy views over the source parquet.
    ``release`` removes what was written.
    """
    if not materialize_tables:
        return testdata.build_tables(spark, sf_dir)
    key = (_app(spark), os.path.abspath(sf_dir))
    with _lock:
        if key in _loaded:
            return _loaded[key]
        _loaded[key] = _load_and_write(spark, sf_dir)
        return _loaded[key]


def release(spark: SparkSession) -> None:
    """Drop the fact tables and CSV copies this session wrote, and their files."""
    app = _app(spark)
    with _lock:
        for key in [k for k in _loaded if k[0] == app]:
            del _loaded[key]
        for name, path in _written.pop(app, []):
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _load_and_write(spark: SparkSession, sf_dir: str) -> Tables:
    token = uuid.uuid4().hex[:10]
    root = f"{storage_root(spark)}/marginlens/{os.path.basename(os.path.abspath(sf_dir))}-{token}"
    rows = testdata.read_source(spark, sf_dir, "lineitem").count()  # from the files' footers
    buckets = fact_buckets(spark, input_bytes(spark, os.path.join(sf_dir, "lineitem.parquet")), rows * LINE_BYTES)
    lines = _write_bucketed(
        spark, testdata.order_lines(spark, sf_dir, buckets), f"{root}/order_lines", f"marginlens_{token}_order_lines",
        "order_date", buckets, dealt=True,
    )
    returns = _write_bucketed(
        spark, testdata.returns_from_lines(lines), f"{root}/fact_returns", f"marginlens_{token}_fact_returns",
        "return_date", buckets,
    )
    # The dimensions and the spend table are projections of one source table
    # each (no join): reading them through the mapping costs the same as
    # reading a written copy, so they stay views over the sources.
    lazy = testdata.build_tables(spark, sf_dir, lines=lines)
    return Tables(
        dim_sku=lazy.dim_sku,
        dim_store=lazy.dim_store,
        fact_orders=testdata.orders_from_lines(lines),
        fact_returns=returns,
        fact_marketing_spend=lazy.fact_marketing_spend,
    )


def _mart_builders() -> dict:
    from ..operators import marts as m

    return {
        "v_daily_pnl": m.daily_pnl,
        "v_returns_analytics": m.returns_analytics,
        "v_return_rate": m.return_rate,
        "v_price_parity": m.price_parity,
        "v_sku_profitability": m.sku_profitability,
        "v_marketing_efficiency": m.marketing_efficiency,
        "v_store_performance": m.store_performance,
    }


def register_views(tables: Tables, marts: bool = True, replace: bool = False) -> list[str]:
    """Register the raw tables under their own names and the (lazily defined)
    mart views with a ``v_`` prefix, as temp views, so SQL text can name them.
    A view or table of the session with such a name is not replaced unless
    ``replace`` says so: it raises. Returns the registered names."""
    frames = dict(tables.items()) | ({name: build(tables) for name, build in _mart_builders().items()} if marts else {})
    taken = [] if replace else [n for n in frames if tables.spark.catalog.tableExists(n)]
    if taken:
        raise ValueError(f"the session has these names already: {', '.join(taken)} (replace=True replaces them)")
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


_SKIPPED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"


def run_sql(tables: Tables, sql_text: str) -> DataFrame:
    """The result of ``sql_text`` with the names of the tables
    (``raw.fact_orders``) and mart views (``marts.v_daily_pnl``) bound to
    ``tables``. Spark's parser says which names are relations, so columns,
    aliases, texts and other databases' tables of such a name stay. A bare name
    means our table unless the session or a WITH clause has one of that name.
    The views made for it have names of their own and are dropped once the
    statement is analysed."""
    spark = tables.spark
    raw, marts = dict(tables.items()), _mart_builders()
    bound: dict[str, str] = {}
    out, done = [], 0
    relations, ctes = _relations(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql_text))

    def unqualified(text: str) -> str:
        """Columns as ``raw.dim_sku.sku_id`` follow their table, whose alias has no ``raw``."""
        own = "|".join(bound)
        return re.sub(rf"{_SKIPPED}|\b(?:raw|marts)\s*\.\s*((?:{own})\s*\.)", lambda m: m[1] or m[0], text, flags=re.IGNORECASE | re.DOTALL) if own else text

    try:
        for start, stop, parts, aliased in sorted(relations):
            name, space = parts[-1].lower(), ".".join(parts[:-1]).lower()
            ours = name in raw or name in marts
            if space:
                ours = ours and space == ("raw" if name in raw else "marts")
            else:
                ours = ours and name not in ctes and not spark.catalog.tableExists(name)
            if ours:
                if name not in bound:
                    bound[name] = f"marginlens_{uuid.uuid4().hex[:10]}_{name}"
                    (raw[name] if name in raw else marts[name](tables)).createOrReplaceTempView(bound[name])
                out += [(sql_text[done:start], True), (bound[name] + ("" if aliased else f" AS {name}"), False)]
            else:
                out += [(sql_text[done:start], True), (sql_text[start:stop], False)]
            done = stop
        out.append((sql_text[done:], True))
        return spark.sql("".join(unqualified(text) if free else text for text, free in out))
    finally:
        for view in bound.values():
            spark.catalog.dropTempView(view)


def _relations(plan) -> tuple[list[tuple[int, int, tuple[str, ...], bool]], set[str]]:
    """(start, end, name parts, has an alias) of every relation that a parsed
    plan names, and the names its WITH clauses define."""
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    found, ctes, left = [], set(), [(plan, False)]
    while left:
        node, aliased = left.pop()
        kind = node.nodeName()
        if kind == "UnresolvedRelation":
            at = node.origin()
            parts = tuple(each(node.multipartIdentifier()))
            found.append((at.startIndex().get(), at.stopIndex().get() + 1, parts, aliased))
        if kind == "UnresolvedWith":
            ctes |= {c._1().lower() for c in each(node.cteRelations())}
            left += [(c._2(), False) for c in each(node.cteRelations())]
        # No alias may stand between a name and its TABLESAMPLE.
        left += [(c, kind in ("SubqueryAlias", "Sample")) for c in each(node.children())]
        left += [(c, False) for c in each(node.subqueries())]
    return found, ctes
