"""Per-window graphs with subject, file and netflow nodes: node and edge tables with features.

A graph is rows with one window_id in three tables (windows, nodes, edges), so that all windows are
built in one pass with window_id as a grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import address_code, clipped_share, relative_position, token_sketch

#: Fixed value: the relations of a graph, as source and target node types.
RELATIONS = (
    ("subject", "fileobject"),
    ("subject", "netflow"),
    ("subject", "subject"),
    ("fileobject", "subject"),
    ("netflow", "subject"),
)
#: Feature widths that the tables must have.
WIDTHS = {"subject": 38, "fileobject": 4, "netflow": 8, "edge": 6}


def window_nodes(kept_edges: DataFrame) -> DataFrame:
    """window_id, uuid: the distinct ends of a window's edges."""
    ends = kept_edges.select("window_id", F.explode(F.array("src", "dst")).alias("uuid"))
    return ends.where(F.col("uuid").isNotNull()).distinct()


def typed_nodes(subjects: DataFrame, fileobjects: DataFrame, netflows: DataFrame) -> DataFrame:
    """uuid, node_type; a uuid in several tables has several types."""
    tables = (("subject", subjects), ("fileobject", fileobjects), ("netflow", netflows))
    parts = [t.where(F.col("uuid").isNotNull()).select("uuid", F.lit(name).alias("node_type")).distinct() for name, t in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def node_type_lookup(uuids: DataFrame, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """uuids with node_type: that of the first table in the list that has the uuid, else `unknown`."""
    ranked = None
    for rank, (name, table) in enumerate(tables):
        part = table.where(F.col("uuid").isNotNull()).select("uuid", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("t"))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = ranked.groupBy("uuid").agg(F.min("t")["name"].alias("node_type"))
    return uuids.join(first, "uuid", "left").withColumn("node_type", F.coalesce("node_type", F.lit("unknown")))


def in_order(df: DataFrame, keys: list[str], column: str, letters: int = 4) -> DataFrame:
    """df with `place`: from 0 in the order of the text `column` within the keys.

    Rows are numbered within the first letters of the text, and the rows of all smaller beginnings are
    added; so a large group is sorted by as many tasks as it has beginnings. Counts of beginnings are a
    small table.
    """
    own = df.withColumn("__p", F.substring(column, 1, letters))
    counts = own.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "__p", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(column)) - 1
    out = own.withColumn("__within", within).join(counts, [*keys, "__p"])
    return out.withColumn("place", (F.col("__before") + F.col("__within")).cast("long")).drop("__p", "__within", "__before")


def one_row(table: DataFrame, key: str = "uuid") -> DataFrame:
    """One row for each key, whichever order rows come in: the greatest by its other columns."""
    rest = F.struct(*[c for c in table.columns if c != key])
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rest).alias("__r")).select(key, "__r.*")


def graph_nodes(kept_edges: DataFrame, types: DataFrame) -> DataFrame:
    """window_id, node_type, uuid, node_idx: places from 0 within window and type, in the order of the uuids."""
    nodes = window_nodes(kept_edges).join(types, "uuid")
    return in_order(nodes, ["window_id", "node_type"], "uuid").select("window_id", "node_type", "uuid", F.col("place").alias("node_idx"))


def graph_edges(kept_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the five relations with relation, src_type, dst_type, src_idx, dst_idx."""
    ends = lambda side: nodes.select(
        "window_id", F.col("uuid").alias(side), F.col("node_type").alias(f"{side}_type"), F.col("node_idx").alias(f"{side}_idx")
    )
    relation = F.concat_ws("->", "src_type", "dst_type")
    joined = kept_edges.join(ends("src"), ["window_id", "src"]).join(ends("dst"), ["window_id", "dst"])
    return joined.withColumn("relation", relation).where(F.col("relation").isin(*["->".join(r) for r in RELATIONS]))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with deg_in, deg_out, deg_total over the listed relations; one shuffle of the edges' ends."""
    ends = edges.select("window_id", F.explode(F.array(
        F.struct(F.col("src_type").alias("node_type"), F.col("src_idx").alias("node_idx"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst_type").alias("node_type"), F.col("dst_idx").alias("node_idx"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e")).select("window_id", "e.*")
    counted = ends.groupBy("window_id", "node_type", "node_idx").agg(F.sum("i").alias("deg_in"), F.sum("o").alias("deg_out"))
    out = nodes.join(counted, ["window_id", "node_type", "node_idx"], "left")
    deg_in, deg_out = F.coalesce("deg_in", F.lit(0)), F.coalesce("deg_out", F.lit(0))
    return out.withColumns({"deg_in": deg_in, "deg_out": deg_out, "deg_total": deg_in + deg_out})


def _floats(*columns) -> Column:
    return F.array(*[c.cast("float") for c in columns])


def _degrees() -> Column:
    return _floats(F.col("deg_in"), F.col("deg_out"), F.col("deg_total"))


def subject_features(nodes: DataFrame, subjects: DataFrame, windows: DataFrame) -> DataFrame:
    """38 columns: has parent, start position, 32 token bins, cid mod 8, degrees. nodes: with degrees."""
    own = nodes.where(F.col("node_type") == "subject").join(one_row(subjects), "uuid").join(windows.select("window_id", "start_ns", "end_ns"), "window_id")
    position = relative_position(F.col("startTimestampNanos"), F.col("start_ns"), F.col("end_ns"))
    head = _floats(F.col("parentSubject").isNotNull().cast("int"), position)
    tail = _floats(F.pmod(F.coalesce("cid", F.lit(0)), F.lit(8)))
    return own.select("window_id", "node_idx", "uuid", F.concat(head, token_sketch(F.col("cmdLine")), tail, _degrees()).alias("x"))


def file_type_codes(nodes: DataFrame, fileobjects: DataFrame) -> DataFrame:
    """window_id, uuid, file_type, code: types of the window's files in order, from 1; a null type is UNK."""
    own = nodes.where(F.col("node_type") == "fileobject").join(one_row(fileobjects.select("uuid", F.coalesce("file_type", F.lit("UNK")).alias("file_type"))), "uuid")
    # Few types: they are numbered by themselves and joined, so that a window's files are never sorted in one task.
    types = own.select("window_id", "file_type").distinct()
    codes = types.withColumn("code", F.row_number().over(Window.partitionBy("window_id").orderBy("file_type")))
    return own.join(codes, ["window_id", "file_type"])


def file_features(nodes: DataFrame, fileobjects: DataFrame) -> DataFrame:
    """4 columns: type code, degrees."""
    coded = file_type_codes(nodes, fileobjects)
    return coded.select("window_id", "node_idx", "uuid", F.concat(_floats(F.col("code")), _degrees()).alias("x"))


def netflow_features(nodes: DataFrame, netflows: DataFrame) -> DataFrame:
    """8 columns: local address and port, remote address and port, protocol, degrees."""
    own = nodes.where(F.col("node_type") == "netflow").join(one_row(netflows), "uuid")
    zero = lambda c: F.coalesce(c, F.lit(0))
    head = _floats(address_code(F.col("localAddress")), zero("localPort"), address_code(F.col("remoteAddress")), zero("remotePort"), zero("ipProtocol"))
    return own.select("window_id", "node_idx", "uuid", F.concat(head, _degrees()).alias("x"))


def edge_features(edges: DataFrame) -> DataFrame:
    """6 columns: type id, count, span and first position as shares of the window, log of size sum and maximum."""
    length = F.col("end_ns") - F.col("start_ns")
    x = _floats(
        F.col("edge_type_id"), F.col("count"), clipped_share(F.col("last_ts") - F.col("first_ts"), length), clipped_share(F.col("first_ts") - F.col("start_ns"), length),
        F.log1p(F.col("size_sum").cast("double")), F.log1p(F.col("size_max").cast("double")),
    )
    return edges.select("window_id", "relation", "src_idx", "dst_idx", x.alias("edge_attr"))


def build_summary(windows: DataFrame, window_events: DataFrame, kept_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each window: label, nodes by type, edges, and why it was skipped, if it was."""
    n_events = window_events.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_events"))
    n_kept = kept_edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_kept"))
    by_type = nodes.groupBy("window_id").agg(
        *[F.count_if(F.col("node_type") == t).alias(f"N_{t}") for t in ("subject", "fileobject", "netflow")]
    )
    n_edges = edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("E_total"))
    out = windows.select("window_id", "label")
    for part in (n_events, n_kept, by_type, n_edges):
        out = out.join(part, "window_id", "left")
    out = out.na.fill(0)
    reason = (
        F.when(F.col("n_events") == 0, "no_events").when(F.col("n_kept") == 0, "no_kept_edges")
        .when(F.col("N_subject") + F.col("N_fileobject") + F.col("N_netflow") == 0, "no_nodes")
    )
    return out.select("window_id", "label", "N_subject", "N_fileobject", "N_netflow", "E_total", reason.isNotNull().alias("skipped"), reason.alias("reason"))


def integrity(nodes: DataFrame, edges: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each window: number of edge ends without a node, empty nodes, empty edges."""
    sizes = nodes.groupBy("window_id", "node_type").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select("window_id", F.explode(F.array(
        F.struct(F.col("src_type").alias("node_type"), F.col("src_idx").alias("idx")), F.struct(F.col("dst_type").alias("node_type"), F.col("dst_idx").alias("idx"))
    )).alias("e")).select("window_id", "e.*")
    bad = ends.join(sizes, ["window_id", "node_type"], "left").groupBy("window_id").agg(F.count_if(F.col("idx") >= F.coalesce("n", F.lit(0))).alias("n_out_of_range"), F.count(F.lit(1)).alias("n_ends"))
    total = sizes.groupBy("window_id").agg(F.sum("n").alias("n_nodes"))
    out = windows.select("window_id").join(total, "window_id", "left").join(bad, "window_id", "left").na.fill(0)
    return out.select("window_id", "n_out_of_range", (F.col("n_nodes") == 0).alias("empty_nodes"), (F.col("n_ends") == 0).alias("empty_edges"))
