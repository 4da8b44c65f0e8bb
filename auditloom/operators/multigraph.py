"""Multigraphs of tumbling windows: parallel edges stay rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.scalars import bucket
from auditloom.operators.tumbling import WINDOW_NS


def edges(events: DataFrame, width: int = WINDOW_NS) -> DataFrame:
    """window_start_ns, src, dst, event_type, timestampNanos, size, malicious: one edge to each of the event's objects."""
    both = F.explode(F.array("object1_uuid", "object2_uuid"))
    out = events.where(F.col("timestampNanos").isNotNull() & (F.col("subject_uuid") != "")).select(
        bucket(F.col("timestampNanos"), width).alias("window_start_ns"), F.col("subject_uuid").alias("src"), both.alias("dst"),
        "event_type", "timestampNanos", "size", F.coalesce(F.col("malicious") != 0, F.lit(False)).alias("malicious"),
    )
    return out.where(F.col("dst").isNotNull() & (F.col("dst") != ""))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """uuid, degree: ends of edges at the node, so that a loop counts twice."""
    return edge_rows.select(F.explode(F.array("src", "dst")).alias("uuid")).groupBy("uuid").agg(F.count(F.lit(1)).alias("degree"))


def vertices(edge_rows: DataFrame, types: DataFrame) -> DataFrame:
    """uuid, node_type, degree, first_ts, last_ts, malicious (an end of any such edge) of every vertex. types: uuid, node_type."""
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("uuid"), "timestampNanos", "malicious").groupBy("uuid").agg(
        F.count(F.lit(1)).alias("degree"), F.min("timestampNanos").alias("first_ts"), F.max("timestampNanos").alias("last_ts"), F.max("malicious").alias("malicious")
    )
    named = types.groupBy("uuid").agg(F.min("node_type").alias("node_type"))
    return ends.join(named, "uuid", "left").select("uuid", F.coalesce("node_type", F.lit("unknown")).alias("node_type"), "degree", "first_ts", "last_ts", "malicious")


def top_degree(edge_rows: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edge_rows).orderBy(F.desc("degree"), "uuid").limit(k)


def induced_subgraph(edge_rows: DataFrame, k: int = 50) -> DataFrame:
    """Edges between the k nodes of highest degree."""
    top = top_degree(edge_rows, k).select("uuid")
    inner = edge_rows.join(top.withColumnRenamed("uuid", "src"), "src", "left_semi")
    return inner.join(top.withColumnRenamed("uuid", "dst"), "dst", "left_semi")


def first_window(edge_rows: DataFrame) -> DataFrame:
    """Edges of the earliest window; the earliest start is one number."""
    first = edge_rows.agg(F.min("window_start_ns")).first()[0]
    return edge_rows.where(F.col("window_start_ns") == F.lit(first).cast("long"))
