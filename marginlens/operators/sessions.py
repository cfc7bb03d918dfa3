"""Gap sessions: rows of a key belong together while no pause is longer than the gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slices import before, running, sliced
from ..sources.scratch import saved


def numbered(df: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """``df`` with ``session_no``: 1, 2, ... along ``time`` per key; a row whose
    pause to the one before is longer than the gap begins the next (equal to
    the gap: the same session). Rows without a time are session 0, null keys a
    group like any other.

    Rows are dealt by range over (keys, time), so a hot key lies in several
    tasks; the last time seen and the sessions begun are carried from slice to
    slice, which joins a session cut by a slice's edge."""
    cut = sliced(df, keys, [F.col(time).asc_nulls_first()], lambda rows: saved(rows, "sessions"))
    seen = before(cut, keys, {"__last": ("last", F.col(time))})
    pause = F.col(time) - F.col("__last") > F.make_dt_interval(secs=F.lit(gap_seconds))
    begins = (F.col(time).isNotNull() & (F.col("__last").isNull() | pause)).cast("long")
    return running(seen.withColumn("__begins", begins), keys, {"session_no": ("sum", F.col("__begins"))}).select(*df.columns, "session_no")


def gap_sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int, measures: list[Column]) -> DataFrame:
    """A row per key and session: when it started and ended, and ``measures``.
    Rows are summed where they lie before the parts of a session meet."""
    rows = numbered(df, keys, time, gap_seconds)
    return rows.groupBy(*keys, "session_no").agg(F.min(time).alias("started"), F.max(time).alias("ended"), *measures)


def event_sessions(events: DataFrame, gap_seconds: int = 6 * 3600) -> DataFrame:
    """Sessions of every user of the ``events`` table: events, errors and value in each."""
    value = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    measures = [F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), value.alias("value")]
    return gap_sessions(events.select("user_id", "ts", "event_type", "value"), ["user_id"], "ts", gap_seconds, measures)
