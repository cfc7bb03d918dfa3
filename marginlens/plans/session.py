"""Session settings the queries are planned for.

Only settings a Spark user would put in ``spark-defaults.conf``; each is
applied to a builder (new sessions) and never forced on an existing one
except the time zone, which decides how the source timestamps become dates.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, turn a sort-merge join into a broadcast join once a
    # side is *measured* small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Static broadcast only below this estimated size (bytes); bigger sides
    # are shuffled. The dimension tables and grouped frames sit far below it,
    # the facts far above. (Spark's default, stated so the plans can rely on it.)
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # Dates come from timestamps without zone; UTC keeps them unshifted.
    "spark.sql.session.timeZone": "UTC",
    # Bucketed facts: use the bucketing for joins and aggregations on order_id.
    "spark.sql.sources.bucketing.enabled": "true",
    # Parquet: push filters (row-group min/max on the date sort key) and
    # read only the needed columns.
    "spark.sql.parquet.filterPushdown": "true",
    # 128 MiB input splits.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def configure(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Apply the defaults to a builder. ``shuffle_partitions`` sizes the
    shuffle (and with it the fact bucket count): about the cluster's cores
    times 2-3, or total shuffle bytes / 128 MiB, whichever is larger."""
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder
