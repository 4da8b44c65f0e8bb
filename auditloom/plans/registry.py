"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditloom.functions import scalars
from auditloom.operators import edges, graphs, homogeneous, intervals, multigraph, stats, tumbling
from auditloom.plans import model, raw, sql
from auditloom.sources import records, storage, tables, windows
from auditloom.streaming import tumbling as stream

_EDGE = ("window_id", "src", "dst", "event_type", "edge_type_id", "count", "first_ts", "last_ts", "size_sum", "size_max")


def _label_counts(df):
    return df.groupBy("hostId", "malicious").agg(F.count(F.lit(1)).alias("n"))


def _attack_json() -> dict:
    hosts: dict = {}
    for wid, host, s, e in model.ATTACKS:
        hosts.setdefault(host, []).append({"id": wid, "name": wid, "start_ns": s, "end_ns": e})
    return {"attacks_by_host": hosts}


def _lookup(s, d):
    ev = tables.events(s, d)
    uuids = ev.select(F.explode(F.array("subject_uuid", F.coalesce("object1_uuid", F.lit("")), F.coalesce("object2_uuid", F.lit("")))).alias("uuid")).distinct()
    subjects, files, flows = model.node_tables(s, d)
    return graphs.node_type_lookup(uuids, [("subject", subjects), ("fileobject", files), ("netflow", flows)])


def _summary(s, d):
    g = model.graph(s, d)
    return graphs.build_summary(g.tasks, intervals.in_windows(tables.events(s, d), g.tasks), g.kept, g.nodes, g.edges)


def _stats(s, d):
    g = model.graph(s, d)
    return storage.written(stats.graph_stats(g.tasks, g.nodes, g.edges))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _integrity(s, d):
    g = model.graph(s, d)
    return graphs.integrity(g.nodes, g.edges, g.tasks)


def _edge_features(s, d):
    x = graphs.edge_features(model.graph(s, d).edges)
    part = lambda k: F.round(F.col("edge_attr")[k].cast("double"), 4)
    names = ("type_id", "n", "span", "pos", "log_sum", "log_max")
    return x.select("window_id", "relation", "src_idx", "dst_idx", *[part(k).alias(n) for k, n in enumerate(names)])


def _file_features(s, d):
    x = graphs.file_features(model.graph(s, d).nodes, tables.fileobjects(s, d))
    return x.select("window_id", "node_idx", "uuid", *[F.col("x")[k].cast("double").alias(n) for k, n in enumerate(("code", "deg_in", "deg_out", "deg_total"))])


def _subject_features(s, d):
    g = model.graph(s, d)
    return graphs.subject_features(g.nodes, tables.subjects(s, d), g.tasks)


def _subject_columns(s, d):
    """The 38 features: bins of the tokens as text, as most are 0."""
    x = lambda k: F.col("x")[k].cast("double")
    bins = F.array_join(F.transform(F.slice("x", 3, 32), lambda v: v.cast("int").cast("string")), " ")
    names = {0: "has_parent", 34: "cid_mod", 35: "deg_in", 36: "deg_out", 37: "deg_total"}
    return _subject_features(s, d).select("window_id", "node_idx", "uuid", *[x(k).alias(n) for k, n in names.items()], F.round(x(1), 4).alias("position"), bins.alias("bins"))


def _netflow_features(s, d):
    return graphs.netflow_features(model.graph(s, d).nodes, tables.netflows(s, d))


def _netflow_columns(s, d):
    names = ("local_address", "local_port", "remote_address", "remote_port", "protocol", "deg_in", "deg_out", "deg_total")
    return _netflow_features(s, d).select("window_id", "node_idx", "uuid", *[F.col("x")[k].cast("double").alias(n) for k, n in enumerate(names)])


def _widths(s, d):
    g = model.graph(s, d)
    parts = {
        "subject": graphs.subject_features(g.nodes, tables.subjects(s, d), g.tasks), "fileobject": graphs.file_features(g.nodes, tables.fileobjects(s, d)),
        "netflow": graphs.netflow_features(g.nodes, tables.netflows(s, d)), "edge": graphs.edge_features(g.edges),
    }
    return stats.feature_widths(parts, graphs.WIDTHS, {"edge": "edge_attr"}).withColumn("widths", F.array_join("widths", " "))


def _graph_profile(s, d):
    g = model.graph(s, d)
    return stats.table_profile({"graph_node": g.nodes, "graph_edge": g.edges.drop("score")})


def _keys(s, d):
    """Attributes that the raw records of each type have."""
    parsed = records.records(raw.lines(s, d)).where("payload IS NOT NULL")
    keys = parsed.select(F.col("table").alias("file"), F.map_keys("payload").alias("keys")).distinct()
    return stats.key_consistency(keys).withColumn("examples", F.array_join("examples", " "))


def _stream(s, d):
    """The streaming operator run over the table as one batch of input."""
    return stream.stream_counts(tables.events(s, d))


def _multigraph(s, d):
    return multigraph.edges(model.labelled(s, d))


def _file_lines(s, d):
    """Lines read back from gzip files that the raw lines were written to, by a list of globs."""
    folder = f"{storage.shared_folder(s)}/{uuid.uuid4().hex}"
    raw.lines(s, d).write.partitionBy("file").option("compression", "gzip").text(folder)
    return records.read_lines(s, [f"{folder}/file={name}/*.gz" for name in ("nodes.json", "h*.json")])


def _files(s, d):
    parsed = records.records(_file_lines(s, d))
    return parsed.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("parsed").alias("n_parsed"), F.count_if(F.col("table") == "events").alias("n_events"))


def _folder(s, d):
    """Events written by host and read back as a folder: wanted columns, a pushed time range, files by name."""
    folder = f"{storage.shared_folder(s)}/{uuid.uuid4().hex}"
    own = tables.events(s, d).withColumn("file", F.concat("hostId", F.lit(".json")))
    tables.write_table(own, folder, by_file="file", rows_per_file=5_000)
    lo, hi = model.ATTACKS[0][2], model.ATTACKS[5][3]
    held = tables.scan(s, folder, ["uuid", "timestampNanos", "missing"], F.col("timestampNanos").between(lo, hi), name_prefix="part-")
    return held.agg(F.count(F.lit(1)).alias("n"), F.min("timestampNanos").alias("lo"), F.max("timestampNanos").alias("hi"), F.count("uuid").alias("n_uuid"))


def _vertices(s, d):
    return multigraph.vertices(_multigraph(s, d), graphs.typed_nodes(*model.node_tables(s, d)))


def _parsed(s, d):
    return records.records(raw.lines(s, d))


def _scan(s, d):
    return _parsed(s, d).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("parsed").alias("n_parsed"))


def _unwrap(s, d):
    wrapped = F.to_json(F.create_map(F.lit("x"), F.col("subject_uuid")))
    return tables.events(s, d).select("uuid", records.unwrap(wrapped).alias("unwrapped"))


def _ingest(s, d):
    lines = raw.lines(s, d).where("file <> 'nodes.json'")
    parsed = records.parse_events(records.records(lines))
    marked = intervals.label(parsed, model.attack_table(s)).withColumn("file", F.concat("hostId", F.lit(".json")))
    return records.ingest_counts(lines, marked)


def _times(s, d):
    ev = tables.events(s, d).select("uuid", "timestampNanos", F.expr("timestamp_micros(timestampNanos div 1000)").alias("at"))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return ev.select("uuid", scalars.to_ns(F.col("timestampNanos").cast("string")).alias("from_number"), scalars.to_ns(iso).alias("from_iso"))


def _homogeneous(s, d):
    w = model.windowed(s, d)
    return homogeneous.edges(w.events, homogeneous.label_by_overlap(w.tasks, model.attack_table(s)), max_edges=model.HOMOGENEOUS_EDGES)


def _homogeneous_nodes(s, d):
    return homogeneous.nodes(_homogeneous(s, d), graphs.typed_nodes(*model.node_tables(s, d)))


def _columns(df, column, names):
    return _rounded(df.select(*[c for c in df.columns if c != column], *[F.col(column)[k].cast("double").alias(n) for k, n in enumerate(names)]), 4)


def _homogeneous_edge_features(s, d):
    types = [r[0] for r in tables.events(s, d).select("event_type").distinct().orderBy("event_type").collect() if r[0] is not None]  # a vocabulary
    return _columns(homogeneous.edge_features(_homogeneous(s, d), types), "edge_attr", [*[f"is_{t}" for t in types], "pos"])


def queries() -> dict:
    t = tables
    return {
        "label_half_open": lambda s, d: _label_counts(model.labelled(s, d)),
        "label_closed": lambda s, d: _label_counts(intervals.label(t.events(s, d), model.attack_table(s), closed=True)),
        "label_audit": lambda s, d: tumbling.label_audit(model.labelled(s, d), ["hostId"]),
        "attack_windows": lambda s, d: intervals.coalesce(windows.interval_table(s, windows.half_open(_attack_json()))),
        "attack_windows_closed": lambda s, d: intervals.coalesce(windows.interval_table(s, windows.closed(_attack_json())), closed=True),
        "attack_windows_ids": lambda s, d: windows.id_table(s, windows.with_ids(_attack_json())),
        "attack_window_listing": lambda s, d: windows.listing_table(s, windows.listing(_attack_json())),
        "coalesce_half_open": lambda s, d: intervals.coalesce(model.attack_table(s)),
        "coalesce_closed": lambda s, d: intervals.coalesce(model.attack_table(s), closed=True),
        "time_bounds": lambda s, d: intervals.time_bounds(t.events(s, d)),
        "tumbling_counts": lambda s, d: tumbling.tumbling_counts(t.events(s, d)),
        "tumbling_counts_stream": _stream,
        "benign_windows": lambda s, d: tumbling.busiest_windows(model.labelled(s, d)),
        "benign_slots": lambda s, d: model.slots(s, d, intervals.SLOT_NS),
        "benign_sample": lambda s, d: intervals.even_sample(model.slots(s, d, model.GRAPH_SLOT_NS), model.SAMPLE_SLOTS),
        "window_tasks": model.tasks,
        "event_type_codes": lambda s, d: edges.event_type_codes(t.events(s, d)),
        "window_events": lambda s, d: model.window_events(s, d).select("window_id", "uuid", "timestampNanos"),
        "edge_aggregate": lambda s, d: model.aggregated(s, d).select(*_EDGE),
        "edge_score": lambda s, d: _rounded(edges.scored(model.aggregated(s, d)).select("window_id", "src", "dst", "event_type", "score")),
        "edge_cap": lambda s, d: _rounded(model.kept(s, d).select(*_EDGE, "score")),
        "window_nodes": lambda s, d: graphs.window_nodes(model.kept(s, d)),
        "node_type_lookup": _lookup,
        "window_build_summary": _summary,
        "graph_nodes": lambda s, d: model.graph(s, d).nodes.select("window_id", "node_type", "uuid", "node_idx"),
        "graph_edges": lambda s, d: model.graph(s, d).edges.select("window_id", "relation", "src", "dst", "event_type", "src_idx", "dst_idx"),
        "node_degrees": lambda s, d: model.graph(s, d).nodes,
        "node_features_subject": _subject_columns,
        "node_features_file": _file_features,
        "node_features_netflow": _netflow_columns,
        "edge_features": _edge_features,
        "file_type_codes": lambda s, d: graphs.file_type_codes(model.graph(s, d).nodes, t.fileobjects(s, d)).select("window_id", "uuid", "file_type", "code"),
        "graph_integrity": lambda s, d: _integrity(s, d),
        "graph_table_profile": _graph_profile,
        "graph_stats": _stats,
        "corpus_summary": lambda s, d: _rounded(stats.corpus_summary(_stats(s, d))),
        "edge_type_freq": lambda s, d: stats.edge_type_freq(model.graph(s, d).edges),
        "class_weights": lambda s, d: _rounded(stats.class_weights(_stats(s, d)), 9),
        "dataset_stats": lambda s, d: _rounded(stats.dataset_stats(_stats(s, d))),
        "array_stats": lambda s, d: _rounded(stats.array_stats(t.events(s, d), "size")),
        "feature_spread": lambda s, d: _rounded(stats.feature_spread(_netflow_features(s, d)), 2),
        "histogram_nodes": lambda s, d: _rounded(stats.histogram(_stats(s, d), "total_nodes", 40)),
        "histogram_edges": lambda s, d: _rounded(stats.histogram(_stats(s, d), "total_edges", 40)),
        "histogram_degree": lambda s, d: _rounded(stats.histogram(model.graph(s, d).nodes, "deg_total", 50)),
        "key_consistency": _keys,
        "feature_width_check": _widths,
        "multigraph_edges": _multigraph,
        "top_degree": lambda s, d: multigraph.top_degree(_multigraph(s, d)),
        "induced_subgraph": lambda s, d: multigraph.induced_subgraph(_multigraph(s, d)),
        "first_window_graph": lambda s, d: multigraph.first_window(_multigraph(s, d)),
        "scan_ndjson": _scan,
        "scan_ndjson_files": _files,
        "scan_parquet_folder": _folder,
        "multigraph_vertices": _vertices,
        "unwrap_union": _unwrap,
        "record_type_counts": lambda s, d: records.record_type_counts(_parsed(s, d)),
        "parse_events": lambda s, d: records.parse_events(_parsed(s, d)),
        "parse_subjects": lambda s, d: records.parse_subjects(_parsed(s, d)).select("uuid", "subject_type", "cid", "parentSubject", "startTimestampNanos"),
        "parse_fileobjects": lambda s, d: records.parse_fileobjects(_parsed(s, d)).select("uuid", "file_type", "size"),
        "parse_netflows": lambda s, d: records.parse_netflows(_parsed(s, d)).select("uuid", "localAddress", "localPort", "remotePort", "ipProtocol"),
        "parse_registry": lambda s, d: records.parse_registry(_parsed(s, d)).select("uuid", "key"),
        "parse_ipc": lambda s, d: records.parse_ipc(_parsed(s, d)).select("uuid", "ipc_type", "fd1", "fd2"),
        "parse_memory": lambda s, d: records.parse_memory(_parsed(s, d)).select("uuid", "memoryAddress", "size"),
        "ingest_counts": _ingest,
        "table_profile": lambda s, d: stats.table_profile({"events": t.events(s, d), "subjects": t.subjects(s, d)}),
        "file_stems": lambda s, d: t.events(s, d).select(F.col("hostId").alias("host"), scalars.file_stem(F.concat(F.lit("run "), "hostId", F.lit(".json.12"))).alias("stem")).distinct(),
        "times_to_ns": _times,
        "homogeneous_edges": lambda s, d: _rounded(_homogeneous(s, d), 4),
        "homogeneous_nodes": lambda s, d: _rounded(_homogeneous_nodes(s, d)),
        "homogeneous_node_features": lambda s, d: _columns(homogeneous.node_features(_homogeneous_nodes(s, d)), "x", ("is_subject", "is_fileobject", "is_netflow", "in_share", "out_share", "total_share")),
        "homogeneous_edge_features": _homogeneous_edge_features,
        "split_assign": lambda s, d: stats.split_assign(t.events(s, d).select("hostId").distinct(), F.col("hostId")),
    }


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.oracle_sql().items() if name in queries()}
