"""Homogeneous graphs of windows: one node table and one edge table with normalised features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import clipped_share
from auditloom.operators.intervals import coalesce


def label_by_overlap(windows: DataFrame, attacks: DataFrame) -> DataFrame:
    """windows with label 1 where a closed window and a merged attack share a point. Both are small tables."""
    merged = coalesce(attacks, closed=True).select(F.col("start_ns").alias("a_s"), F.col("end_ns").alias("a_e"))
    hit = windows.join(merged, (F.col("start_ns") <= F.col("a_e")) & (F.col("a_s") <= F.col("end_ns")), "left_semi").select("window_id").withColumn("label", F.lit(1))
    return windows.drop("label").join(hit, "window_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def edges(window_events: DataFrame, labelled_windows: DataFrame, max_edges: int = 100_000, slices: int = 256) -> DataFrame:
    """window_id, src, dst, event_type, pos (place in the window), label: the first `max_edges` events of each window.

    Events are counted by slices of the window first; only those up to the slice in which the bound is
    reached are put in order.
    """
    share = clipped_share(F.col("timestampNanos") - F.col("start_ns"), F.col("end_ns") - F.col("start_ns"))
    own = window_events.withColumn("__slice", F.floor(share * slices).cast("int"))
    counts = own.groupBy("window_id", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("window_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    wanted = counts.select("window_id", "__slice", F.coalesce(before, F.lit(0)).alias("__before")).where(F.col("__before") < max_edges)
    order = F.row_number().over(Window.partitionBy("window_id", "__slice").orderBy("timestampNanos", "uuid"))
    own = own.join(wanted, ["window_id", "__slice"]).withColumn("__k", order + F.col("__before")).where(F.col("__k") <= max_edges)
    own = own.select(
        "window_id", F.col("subject_uuid").alias("src"), F.coalesce("object2_uuid", "object1_uuid").alias("dst"), "event_type",
        clipped_share(F.col("timestampNanos") - F.col("start_ns"), F.col("end_ns") - F.col("start_ns")).alias("pos"),
    )
    return own.join(labelled_windows.select("window_id", "label"), "window_id")


def nodes(edge_rows: DataFrame, types: DataFrame) -> DataFrame:
    """window_id, uuid, node_type, in_share, out_share, total_share: degrees over the window's largest total degree."""
    ends = edge_rows.select("window_id", F.explode(F.array(
        F.struct(F.col("src").alias("uuid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("uuid"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )).alias("e")).select("window_id", "e.*")
    counted = ends.groupBy("window_id", "uuid").agg(F.sum("i").alias("deg_in"), F.sum("o").alias("deg_out"))
    most = counted.groupBy("window_id").agg(F.max(F.col("deg_in") + F.col("deg_out")).alias("most"))
    typed = counted.join(most, "window_id").join(types, "uuid", "left")
    share = lambda c: c / F.col("most")
    return typed.select(
        "window_id", "uuid", F.coalesce("node_type", F.lit("unknown")).alias("node_type"), share(F.col("deg_in")).alias("in_share"),
        share(F.col("deg_out")).alias("out_share"), share(F.col("deg_in") + F.col("deg_out")).alias("total_share"),
    )


def one_hot(column: str, values: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(column) == v, F.lit(False)).cast("float") for v in values])


def node_features(node_rows: DataFrame) -> DataFrame:
    """window_id, uuid, x: node type as one of three, then the shares of degrees."""
    shares = F.array(*[F.col(c).cast("float") for c in ("in_share", "out_share", "total_share")])
    return node_rows.select("window_id", "uuid", F.concat(one_hot("node_type", ["subject", "fileobject", "netflow"]), shares).alias("x"))


def edge_features(edge_rows: DataFrame, event_types: list[str]) -> DataFrame:
    """window_id, src, dst, edge_attr: event type as one of the vocabulary, then the place in the window."""
    attr = F.concat(one_hot("event_type", event_types), F.array(F.col("pos").cast("float")))
    return edge_rows.select("window_id", "src", "dst", attr.alias("edge_attr"))
