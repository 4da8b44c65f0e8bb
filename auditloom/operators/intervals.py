"""Interval operators over int64 nanoseconds: merging, membership, slots between intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_NS = 180_000_000_000


def coalesce(intervals: DataFrame, closed: bool = False) -> DataFrame:
    """Merged intervals (start_ns, end_ns) of a small table.

    Half-open ones merge where they touch or overlap, and empty ones are dropped. Closed ones also
    merge where the next starts one nanosecond after the end; reversed bounds are swapped.
    """
    if closed:
        own = intervals.select(F.least("start_ns", "end_ns").alias("s"), F.greatest("start_ns", "end_ns").alias("e"))
    else:
        own = intervals.where("end_ns > start_ns").select(F.col("start_ns").alias("s"), F.col("end_ns").alias("e"))
    by_start = Window.orderBy("s", "e")  # a table of windows, not of events: one task
    so_far = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("__new", F.coalesce((F.col("s") > so_far + (1 if closed else 0)).cast("int"), F.lit(1)))
    own = own.withColumn("__island", F.sum("__new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("__island").agg(F.min("s").alias("start_ns"), F.max("e").alias("end_ns")).drop("__island")


def _bin_of(ts: str, width: int) -> Column:
    return F.expr(f"({ts} - pmod({ts}, {width}L)) div {width}L")


def binned(intervals: DataFrame, width: int) -> DataFrame:
    """Each interval once for each bin of the time line that it meets."""
    first, last = _bin_of("start_ns", width), _bin_of("end_ns", width)
    return intervals.withColumn("__bin", F.explode(F.sequence(first, last)))


def label(events: DataFrame, intervals: DataFrame, closed: bool = False, bin_ns: int = 3_600_000_000_000) -> DataFrame:
    """Events with `malicious` 1 where their time lies in an interval, else 0.

    A bin equi-join with the exact bounds as residual: an event has one bin, and merged intervals
    are disjoint, so no event is doubled. Events without a time are dropped.
    """
    merged = binned(coalesce(intervals, closed), bin_ns).select(F.col("start_ns").alias("__s"), F.col("end_ns").alias("__e"), F.col("__bin").alias("__b"))
    ts = F.col("timestampNanos")
    inside = (ts >= F.col("__s")) & ((ts <= F.col("__e")) if closed else (ts < F.col("__e")))
    own = events.drop("malicious").where(ts.isNotNull()).withColumn("__bin", _bin_of("timestampNanos", bin_ns))
    joined = own.join(merged, (F.col("__bin") == F.col("__b")) & inside, "left")
    return joined.withColumn("malicious", F.col("__s").isNotNull().cast("int")).drop("__bin", "__b", "__s", "__e")


def span(windows: DataFrame) -> tuple[int, int, int] | None:
    """Least start, greatest end and mean width of a small table of windows: three numbers, or None where there are no windows."""
    lo, hi, width = windows.agg(F.min("start_ns"), F.max("end_ns"), F.avg(F.col("end_ns") - F.col("start_ns"))).first()
    return None if lo is None else (lo, hi, max(int(width), 1_000_000_000))


def in_windows(events: DataFrame, windows: DataFrame, bin_ns: int | None = None) -> DataFrame:
    """A row for each event and closed window that holds it: the event's columns and window_id, start_ns, end_ns.

    Windows may overlap. One pass over the events, whatever the number of windows. Events outside the
    windows' least and greatest time are filtered by literals, which a scan can push down; bins are as
    wide as windows are on average, so that an event meets few windows that don't hold it.
    """
    ts = F.col("timestampNanos")
    bounds = span(windows)
    if bounds is None:
        events, bounds = events.where(F.lit(False)), (0, 0, 1)
    lo, hi, width = bounds
    bin_ns = bin_ns or width
    w = binned(windows.select("window_id", "start_ns", "end_ns"), bin_ns)
    own = events.where(ts.between(lo, hi)).withColumn("__bin", _bin_of("timestampNanos", bin_ns))
    return own.join(w, "__bin").where(ts.between(F.col("start_ns"), F.col("end_ns"))).drop("__bin")


def time_bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("timestampNanos").alias("min_ts"), F.max("timestampNanos").alias("max_ts"))


def free_slots(bounds: DataFrame, attacks: DataFrame, width: int = SLOT_NS) -> DataFrame:
    """Closed slots [start, start + width] back to back between merged closed attacks.

    bounds: one row min_ts, max_ts. A gap begins at min_ts or one after an attack and ends one before
    the next attack or at max_ts; it holds as many slots as fit, so no cursor has to walk the line.
    """
    merged = coalesce(attacks, closed=True)
    edge = bounds.select(F.col("min_ts").alias("lo"), F.col("max_ts").alias("hi"))
    held = merged.join(F.broadcast(edge), F.col("end_ns") >= F.col("lo"))  # one row of bounds
    starts = held.select("lo", "hi", (F.col("end_ns") + 1).alias("s")).unionByName(edge.select("lo", "hi", F.col("lo").alias("s")))
    points = starts.select("lo", "hi", "s", F.lit(None).cast("long").alias("a")).unionByName(
        held.select("lo", "hi", F.col("start_ns").alias("s"), F.col("start_ns").alias("a"))
    )
    order = Window.orderBy("s", F.col("a").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    gaps = points.withColumn("next", F.min("a").over(order)).where(F.col("a").isNull())
    stop = F.least(F.coalesce(F.col("next") - 1, F.col("hi")), F.col("hi"))
    gaps = gaps.withColumn("stop", stop)
    gaps = gaps.where(F.col("stop") - F.col("s") >= width).withColumn("n", F.expr(f"(stop - s - {width}L) div {width + 1}L + 1"))
    return gaps.select(F.explode(F.expr(f"transform(sequence(0L, n - 1), k -> s + k * {width + 1}L)")).alias("start_ns")).withColumn("end_ns", F.col("start_ns") + width)


def even_sample(slots: DataFrame, k: int = 1000) -> DataFrame:
    """k slots by evenly spaced place in time order; all of them where there are no more than k."""
    n = slots.count()
    if n <= k:
        return slots
    numbered = slots.withColumn("__i", F.row_number().over(Window.orderBy("start_ns")) - 1)  # slots, not events: one task
    step = (n - 1) / (k - 1)
    wanted = slots.sparkSession.range(k).select(
        F.when(F.col("id") == k - 1, F.lit(n - 1)).otherwise(F.floor(F.col("id") * F.lit(step))).cast("long").alias("__w")
    )
    return numbered.join(wanted.distinct(), F.col("__i") == F.col("__w"), "left_semi").drop("__i")


def window_tasks(attacks: DataFrame, slots: DataFrame) -> DataFrame:
    """window_id, start_ns, end_ns, label: attack windows with label 1, free slots numbered in time order with label 0."""
    number = F.row_number().over(Window.orderBy("start_ns")) - 1
    benign = slots.select(F.format_string("benign_%06d", number.cast("int")).alias("window_id"), "start_ns", "end_ns", F.lit(0).alias("label"))
    return attacks.select("window_id", "start_ns", "end_ns", F.lit(1).alias("label")).unionByName(benign)
