"""What the queries share: attack windows as values, and the graph tables over the driver's data.

The windows cover touching, nested, empty, one-nanosecond and reversed bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import edges, graphs, intervals
from auditloom.sources import storage, tables, windows

_DAY0 = 1_704_067_200_000_000_000
_HOUR = 3_600_000_000_000
ATTACKS = [
    ("a0", "h0", _DAY0 + 26 * _HOUR, _DAY0 + 29 * _HOUR),
    ("a1", "h1", _DAY0 + 29 * _HOUR, _DAY0 + 30 * _HOUR + _HOUR // 2),
    ("a2", "h2", _DAY0 + 82 * _HOUR, _DAY0 + 90 * _HOUR),
    ("a3", "h2", _DAY0 + 83 * _HOUR, _DAY0 + 84 * _HOUR),
    ("a4", "h3", _DAY0 + 120 * _HOUR, _DAY0 + 120 * _HOUR),
    ("a5", "h0", _DAY0 + 212 * _HOUR, _DAY0 + 236 * _HOUR),
    ("a6", "h1", _DAY0 + 400 * _HOUR, _DAY0 + 400 * _HOUR + 1),
    ("a7", "h3", _DAY0 + 604 * _HOUR, _DAY0 + 600 * _HOUR),
]
#: Graphs are built for wider slots than the default, as the driver's events are sparse.
GRAPH_SLOT_NS = 2 * _HOUR
#: Slots that graphs are built for: all there are, as the driver's tables have no more than 337 of this width.
GRAPH_SLOTS = 1000
#: Slots of the query that samples them.
SAMPLE_SLOTS = 60
#: Events of a window that the homogeneous graphs keep.
HOMOGENEOUS_EDGES = 100_000


def attack_table(spark: SparkSession) -> DataFrame:
    return windows.id_table(spark, ATTACKS)


def closed_attacks(spark: SparkSession) -> DataFrame:
    return windows.id_table(spark, [(i, h, min(s, e), max(s, e)) for i, h, s, e in ATTACKS])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.label(tables.events(spark, sf_dir), attack_table(spark))


def slots(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    return intervals.free_slots(intervals.time_bounds(tables.events(spark, sf_dir)), attack_table(spark), width)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.window_tasks(closed_attacks(spark), intervals.even_sample(slots(spark, sf_dir, GRAPH_SLOT_NS), GRAPH_SLOTS))


@dataclass
class Windows:
    """What all graph queries start from; each table is written once."""

    tasks: DataFrame
    codes: DataFrame
    events: DataFrame


def windowed(spark: SparkSession, sf_dir: str) -> Windows:
    """Two scans of the events: their types with least and greatest times, and the events that the windows hold."""
    types = storage.written(tables.events(spark, sf_dir).groupBy("event_type").agg(F.min("timestampNanos").alias("lo"), F.max("timestampNanos").alias("hi")))
    bounds = types.agg(F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"))
    free = storage.written(intervals.free_slots(bounds, attack_table(spark), GRAPH_SLOT_NS))
    own = storage.written(intervals.window_tasks(closed_attacks(spark), intervals.even_sample(free, GRAPH_SLOTS)))
    between = intervals.span(own)
    held = intervals.in_windows(tables.events(spark, sf_dir, between and between[:2]), own)
    return Windows(own, edges.event_type_codes(types), held)


def window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).events


def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(spark, sf_dir)
    return edges.aggregate(w.events, w.codes)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.cap(storage.written(edges.scored(aggregated(spark, sf_dir))))


def node_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables.subjects(spark, sf_dir), tables.fileobjects(spark, sf_dir), tables.netflows(spark, sf_dir)


@dataclass
class Graph:
    """All windows' graphs: nodes with degrees, typed edges, capped edges, and the windows."""

    nodes: DataFrame
    edges: DataFrame
    kept: DataFrame
    tasks: DataFrame


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    w = windowed(spark, sf_dir)
    own = storage.written(edges.cap(storage.written(edges.scored(edges.aggregate(w.events, w.codes)))))
    nodes = storage.written(graphs.graph_nodes(own, graphs.typed_nodes(*node_tables(spark, sf_dir))))
    typed = graphs.graph_edges(own, nodes)
    return Graph(graphs.node_degrees(nodes, typed), typed, own, w.tasks)
