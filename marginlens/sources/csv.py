"""CSV load layer: the reference's input format.

Two readers, as in the reference: a typed one following the warehouse file
format (header line, comma, optional double quotes, both the empty field and
the text NULL read as NULL) and an inferred one (header, types guessed).
Inferred amounts are doubles; ``load_csv_dir`` casts them to the declared
types, rounded to the declared scale, so both readers give equal tables.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import money_sum
from .catalog import note_written, storage_root
from .schemas import SCHEMAS
from .tables import Tables


def read_csv_typed(spark: SparkSession, path: str, table: str) -> DataFrame:
    return (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("sep", ",")
        .option("quote", '"')
        .option("nullValue", "NULL")
        # A quoted empty field is read through emptyValue; mapping it to the
        # null token makes '""' NULL as well.
        .option("emptyValue", "NULL")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def as_declared(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in their declared types; a decimal is the
    shortest text of the double, rounded half up to the declared scale. The
    inferred reader keeps the text NULL in string columns; here it is NULL."""
    cols = []
    for f in SCHEMAS[table].fields:
        text = F.col(f.name).cast("string")
        cols.append(F.when(text != "NULL", text).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def load_csv_dir(spark: SparkSession, data_dir: str, typed: bool = True) -> Tables:
    """Read ``<data_dir>/<table>.csv`` for the five tables (a file or a
    directory of part files each)."""
    frames = {}
    for name in SCHEMAS:
        path = os.path.join(data_dir, f"{name}.csv")
        frames[name] = read_csv_typed(spark, path, name) if typed else as_declared(read_csv_inferred(spark, path), name)
    return Tables(**frames)


def write_csv_dir(tables: Tables, data_dir: str) -> None:
    """Write the five tables as the CSV files that ``load_csv_dir`` reads."""
    for name, df in tables.items():
        df.write.option("header", True).option("nullValue", "NULL").csv(os.path.join(data_dir, f"{name}.csv"))


def csv_totals(t: Tables) -> DataFrame:
    """The scan of the input format: the tables are written as CSV under the
    session's shared folder and read by both readers. Per reader: orders and
    revenue by channel, returns and refunds by reason."""
    at = f"{storage_root(t.spark)}/marginlens/csv-{uuid.uuid4().hex[:10]}"
    write_csv_dir(t, at)
    note_written(t.spark, at)
    parts = []
    for reader, typed in (("typed", True), ("inferred", False)):
        own = load_csv_dir(t.spark, at, typed)
        for fact, key, amount in ((own.fact_orders, "channel", "gross_revenue"), (own.fact_returns, "return_reason", "refund_amount")):
            sums = fact.groupBy(key).agg(F.count(F.lit(1)).alias("n"), money_sum(amount).alias("amount"))
            parts.append(sums.select(F.lit(reader).alias("reader"), F.lit(key).alias("part"), F.col(key).alias("name"), "n", "amount"))
    return reduce(DataFrame.unionByName, parts)
