"""Typed edges of a window: aggregation, type codes, scores and the cap by node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import edge_score


def event_type_codes(events: DataFrame) -> DataFrame:
    """event_type, edge_type_id: codes from 0 in the order of the distinct types (a vocabulary: one task numbers it)."""
    types = events.where(F.col("event_type").isNotNull()).select("event_type").distinct()
    return types.withColumn("edge_type_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))


def aggregate(window_events: DataFrame, codes: DataFrame) -> DataFrame:
    """An edge for each window, subject, object and event type (nulls are values): count, first_ts, last_ts, size_sum, size_max, edge_type_id.

    The object is object2 where there is one, else object1. A type without a code gets 0.
    """
    edges = window_events.groupBy(
        "window_id", "start_ns", "end_ns", F.col("subject_uuid").alias("src"), F.coalesce("object2_uuid", "object1_uuid").alias("dst"), "event_type"
    ).agg(
        F.count(F.lit(1)).alias("count"), F.min("timestampNanos").alias("first_ts"), F.max("timestampNanos").alias("last_ts"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size_sum"), F.coalesce(F.max("size"), F.lit(0)).alias("size_max"),
    )
    # The vocabulary of event types is small (tens), and nothing here depends on how Spark joins it.
    return edges.join(codes, "event_type", "left").withColumn("edge_type_id", F.coalesce("edge_type_id", F.lit(0)))


def scored(edges: DataFrame) -> DataFrame:
    return edges.withColumn("score", edge_score(F.col("count"), F.col("size_sum"), F.col("last_ts") - F.col("first_ts")))


def cap(edges: DataFrame) -> DataFrame:
    """Edges that are the best of their source and type, or of their target and type, within their window.

    A node can keep several edges of a type: each may be the best of its other end. Ties go to the
    first by source, target and type, nulls last.
    """
    own = edges if "score" in edges.columns else scored(edges)
    named = lambda c: [F.col(c).isNull().alias(f"{c}_missing"), F.col(c).alias(f"{c}_by")]
    place = F.struct(F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("low"), *named("src"), *named("dst"), *named("event_type"), F.struct(*own.columns).alias("row"))

    def best(end: str) -> DataFrame:
        # An aggregate rather than a ranking window: a node with very many edges is reduced before the shuffle.
        return own.groupBy("window_id", end, "edge_type_id").agg(F.min(place).alias("first")).select("first.row.*")

    return best("src").unionByName(best("dst")).dropDuplicates(["window_id", "src", "dst", "event_type"])
