"""Tumbling counts over a stream of events; equals the batch operator once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.tumbling import WINDOW_NS


def stream_counts(events: DataFrame, width: int = WINDOW_NS, delay: str = "10 minutes") -> DataFrame:
    """host, window_start_ns, n of a streaming or batch table with hostId and timestampNanos.

    Event time is needed in microseconds for the watermark; bucket starts are whole seconds, so
    nothing is lost. Events later than `delay` behind the newest are dropped by the watermark.
    """
    timed = events.where(F.col("timestampNanos").isNotNull()).select(
        F.coalesce("hostId", F.lit("UNKNOWN")).alias("host"), F.timestamp_micros(F.expr("(timestampNanos - pmod(timestampNanos, 1000L)) div 1000L")).alias("at")
    )
    counted = timed.withWatermark("at", delay).groupBy("host", F.window("at", f"{width // 1_000_000_000} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("host", (F.unix_micros(F.col("window.start")) * 1000).alias("window_start_ns"), "n")
