"""Counts in tumbling buckets and the busiest buckets of each host and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import HOUR_NS, bucket
from auditloom.sources.schemas import HOST_COLUMNS, TIME_COLUMNS

WINDOW_NS = 600_000_000_000


def first_column(df: DataFrame, candidates) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def tumbling_counts(events: DataFrame, width: int = WINDOW_NS) -> DataFrame:
    """host, window_start_ns, n. The first known time and host columns are used; a null host is UNKNOWN."""
    time, host = first_column(events, TIME_COLUMNS), first_column(events, HOST_COLUMNS)
    if time is None:
        raise ValueError("no time column")
    name = F.coalesce(F.col(host).cast("string"), F.lit("UNKNOWN")) if host else F.lit("UNKNOWN")
    own = events.where(F.col(time).isNotNull()).select(name.alias("host"), bucket(F.col(time).cast("long"), width).alias("window_start_ns"))
    return own.groupBy("host", "window_start_ns").agg(F.count(F.lit(1)).alias("n"))


def busiest_windows(events: DataFrame, per_hour: int = 1, width: int = WINDOW_NS) -> DataFrame:
    """host, window_start_ns of the `per_hour` fullest benign buckets of each host and hour (of the bucket's start); ties: earliest."""
    if "malicious" in events.columns:
        events = events.where(F.coalesce("malicious", F.lit(0)) == 0)
    counts = tumbling_counts(events, width).withColumn("__hour", bucket(F.col("window_start_ns"), HOUR_NS))
    place = F.row_number().over(Window.partitionBy("host", "__hour").orderBy(F.desc("n"), "window_start_ns"))
    return counts.withColumn("__k", place).where(F.col("__k") <= per_hour).select("host", "window_start_ns")


def label_audit(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many labels are 1, not 1, 0 and not 0; a null is neither 1 nor 0, so it counts as not 1 and as not 0."""
    m = F.col("malicious")
    one, zero = F.coalesce(m == 1, F.lit(False)), F.coalesce(m == 0, F.lit(False))
    return events.groupBy(*(by or [])).agg(
        F.count_if(one).alias("n_one"), F.count_if(~one).alias("n_not_one"), F.count_if(zero).alias("n_zero"), F.count_if(~zero).alias("n_not_zero")
    )
