"""The queries in DuckDB SQL, over one chain of common tables."""

from __future__ import annotations

import hashlib

from auditloom.plans.model import ATTACKS, GRAPH_SLOT_NS, GRAPH_SLOTS, HOMOGENEOUS_EDGES, SAMPLE_SLOTS

_VALUES = ", ".join(f"('{i}', '{h}', CAST({s} AS BIGINT), CAST({e} AS BIGINT))" for i, h, s, e in ATTACKS)


def _merged(name: str, source: str, gap: int) -> str:
    return f"""{name} AS (SELECT min(s) AS s, max(e) AS e FROM (
  SELECT s, e, sum(fresh) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT s, e, CASE WHEN s > max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1
                      WHEN lag(s) OVER (ORDER BY s, e) IS NULL THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY island)"""


def _slots(name: str, width: int) -> str:
    return f"""{name} AS (SELECT CAST(s + k * {width + 1} AS BIGINT) AS s, CAST(s + k * {width + 1} + {width} AS BIGINT) AS e FROM (
  SELECT s, unnest(range(0, (stop - s - {width}) // {width + 1} + 1)) AS k FROM (
    SELECT g.s, least(hi, coalesce((SELECT min(m.s) FROM mc m WHERE m.s >= g.s AND m.e >= lo) - 1, hi)) AS stop
    FROM (SELECT lo AS s FROM bd UNION ALL SELECT e + 1 FROM mc, bd WHERE e >= lo) g, bd) WHERE stop - s >= {width}))"""


def _sampled(name: str, k: int) -> str:
    return f"""{name} AS (SELECT s, e FROM numbered WHERE n <= {k} OR i IN (
  SELECT CASE WHEN k = {k - 1} THEN n - 1 ELSE CAST(floor(k * (CAST(n - 1 AS DOUBLE) / {k - 1})) AS BIGINT) END FROM (SELECT max(n) AS n FROM numbered), range({k}) r(k)))"""


CHAIN = f"""WITH ev AS (
  SELECT CAST(event_id AS VARCHAR) AS uuid, event_type, epoch_ns(ts) AS t,
    CASE WHEN user_id % 30 = 7 THEN 'f' || k WHEN user_id % 30 = 8 THEN 'n' || (k % 20) ELSE 's' || user_id END AS subject_uuid,
    CASE WHEN k % 4 = 0 THEN 'n' || (k % 20) ELSE 'f' || k END AS object1_uuid,
    CASE WHEN user_id % 30 IN (7, 8) THEN 's' || user_id WHEN k % 10 = 3 THEN 's' || ((user_id + k) % 150) END AS object2_uuid,
    CAST(floor(value) AS BIGINT) AS size, 'h' || (user_id % 4) AS hostId
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
aw(window_id, host, s0, e0) AS (VALUES {_VALUES}),
half AS (SELECT s0 AS s, e0 AS e FROM aw WHERE e0 > s0),
clos AS (SELECT window_id, host, least(s0, e0) AS s, greatest(s0, e0) AS e FROM aw),
{_merged('mh', 'half', 0)},
{_merged('mc', 'clos', 1)},
lh AS (SELECT ev.*, CAST(EXISTS (SELECT 1 FROM mh WHERE t >= s AND t < e) AS INTEGER) AS malicious FROM ev),
lc AS (SELECT ev.*, CAST(EXISTS (SELECT 1 FROM mc WHERE t >= s AND t <= e) AS INTEGER) AS malicious FROM ev),
bd AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
tc AS (SELECT hostId AS host, t - t % 600000000000 AS window_start_ns, count(*) AS n FROM ev GROUP BY ALL),
{_slots('s3', 180_000_000_000)},
{_slots('s2h', GRAPH_SLOT_NS)},
numbered AS (SELECT s, e, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM s2h),
{_sampled('sampled', GRAPH_SLOTS)},
{_sampled('few', SAMPLE_SLOTS)},
tk AS (SELECT window_id, s, e, 1 AS label FROM clos UNION ALL
       SELECT 'benign_' || lpad(CAST(row_number() OVER (ORDER BY s) - 1 AS VARCHAR), 6, '0'), s, e, 0 FROM sampled),
we AS (SELECT ev.*, window_id, s, e FROM ev JOIN tk ON t BETWEEN s AND e),
codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS edge_type_id FROM (SELECT DISTINCT event_type FROM ev WHERE event_type IS NOT NULL)),
ag AS (SELECT window_id, s, e, subject_uuid AS src, coalesce(object2_uuid, object1_uuid) AS dst, we.event_type, coalesce(any_value(edge_type_id), 0) AS edge_type_id,
         count(*) AS cnt, min(t) AS first_ts, max(t) AS last_ts, CAST(coalesce(sum(size), 0) AS BIGINT) AS size_sum, coalesce(max(size), 0) AS size_max
       FROM we LEFT JOIN codes ON we.event_type = codes.event_type GROUP BY window_id, s, e, src, dst, we.event_type),
sc AS (SELECT *, 0.6 * ln(1 + CAST(cnt AS DOUBLE)) + 0.3 * ln(1 + CAST(size_sum AS DOUBLE)) + 0.1 * (CAST(cnt AS DOUBLE) / greatest(last_ts - first_ts, 1)) AS score FROM ag),
kp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY window_id, src, edge_type_id ORDER BY score DESC, src, dst, event_type) = 1
                             OR row_number() OVER (PARTITION BY window_id, dst, edge_type_id ORDER BY score DESC, src, dst, event_type) = 1),
sub AS (SELECT 's' || user_id AS uuid, user_id AS cid, CASE WHEN user_id % 3 <> 0 THEN 's' || (user_id - 1) END AS parent,
          CASE WHEN user_id % 7 <> 0 THEN min(epoch_ns(ts)) END AS started FROM events GROUP BY user_id),
fil AS (SELECT DISTINCT 'f' || k AS uuid, coalesce([ 'FILE_OBJECT_BLOCK', 'FILE_OBJECT_DIR', 'FILE_OBJECT_LINK', NULL ][k % 4 + 1], 'UNK') AS file_type
        FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
net AS (SELECT 'n' || i AS uuid, i FROM range(20) r(i)),
ty AS (SELECT uuid, 'subject' AS node_type FROM sub UNION ALL SELECT uuid, 'fileobject' FROM fil UNION ALL SELECT uuid, 'netflow' FROM net),
wn AS (SELECT window_id, src AS uuid FROM kp UNION SELECT window_id, dst FROM kp),
gn AS (SELECT window_id, node_type, wn.uuid, row_number() OVER (PARTITION BY window_id, node_type ORDER BY wn.uuid) - 1 AS node_idx FROM wn JOIN ty ON wn.uuid = ty.uuid),
ge AS (SELECT kp.*, a.node_type || '->' || b.node_type AS relation, a.node_type AS src_type, b.node_type AS dst_type, a.node_idx AS src_idx, b.node_idx AS dst_idx
       FROM kp JOIN gn a ON kp.window_id = a.window_id AND src = a.uuid JOIN gn b ON kp.window_id = b.window_id AND dst = b.uuid
       WHERE a.node_type || '->' || b.node_type IN ('subject->fileobject', 'subject->netflow', 'subject->subject', 'fileobject->subject', 'netflow->subject')),
di AS (SELECT window_id, dst_type AS node_type, dst_idx AS node_idx, count(*) AS n FROM ge GROUP BY ALL),
dq AS (SELECT window_id, src_type AS node_type, src_idx AS node_idx, count(*) AS n FROM ge GROUP BY ALL),
dg AS (SELECT gn.*, coalesce(di.n, 0) AS deg_in, coalesce(dq.n, 0) AS deg_out FROM gn
       LEFT JOIN di ON di.window_id = gn.window_id AND di.node_type = gn.node_type AND di.node_idx = gn.node_idx
       LEFT JOIN dq ON dq.window_id = gn.window_id AND dq.node_type = gn.node_type AND dq.node_idx = gn.node_idx),
fc AS (SELECT dg.*, file_type, dense_rank() OVER (PARTITION BY window_id ORDER BY file_type) AS code FROM dg JOIN fil ON dg.uuid = fil.uuid WHERE node_type = 'fileobject'),
gq AS (SELECT window_id, count(*) AS total_edges, count(*) FILTER (relation = 'subject->fileobject') AS E_subject_fileobject, count(*) FILTER (relation = 'subject->netflow') AS E_subject_netflow, count(*) FILTER (relation = 'subject->subject') AS E_subject_subject, count(*) FILTER (relation = 'fileobject->subject') AS E_fileobject_subject, count(*) FILTER (relation = 'netflow->subject') AS E_netflow_subject FROM ge GROUP BY window_id),
gw AS (SELECT window_id, count(*) AS total_nodes, count(*) FILTER (node_type = 'subject') AS n_subject, count(*) FILTER (node_type = 'fileobject') AS n_fileobject, count(*) FILTER (node_type = 'netflow') AS n_netflow FROM gn GROUP BY window_id),
gs AS (SELECT tk.window_id, label AS graph_label, s AS start_ns, e AS end_ns, total_nodes, coalesce(total_edges, 0) AS total_edges, n_subject, n_fileobject, n_netflow,
         coalesce(E_subject_fileobject, 0) AS E_subject_fileobject, coalesce(E_subject_netflow, 0) AS E_subject_netflow, coalesce(E_subject_subject, 0) AS E_subject_subject, coalesce(E_fileobject_subject, 0) AS E_fileobject_subject, coalesce(E_netflow_subject, 0) AS E_netflow_subject
       FROM tk JOIN gw ON tk.window_id = gw.window_id LEFT JOIN gq ON tk.window_id = gq.window_id),
he AS (SELECT we.*, subject_uuid AS src, coalesce(object2_uuid, object1_uuid) AS dst, least(greatest(CAST(t - s AS DOUBLE) / greatest(e - s, 1), 0.0), 1.0) AS pos
       FROM we QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY t, uuid) <= {HOMOGENEOUS_EDGES}),
hd AS (SELECT window_id, uuid, CAST(sum(i) AS BIGINT) AS deg_in, CAST(sum(o) AS BIGINT) AS deg_out
       FROM (SELECT window_id, src AS uuid, 0 AS i, 1 AS o FROM he UNION ALL SELECT window_id, dst, 1, 0 FROM he) GROUP BY ALL),
hn AS (SELECT window_id, hd.uuid, coalesce(node_type, 'unknown') AS node_type, deg_in / max(deg_in + deg_out) OVER w AS in_share, deg_out / max(deg_in + deg_out) OVER w AS out_share,
         (deg_in + deg_out) / max(deg_in + deg_out) OVER w AS total_share FROM hd LEFT JOIN ty ON hd.uuid = ty.uuid WINDOW w AS (PARTITION BY window_id)),
me AS (SELECT t - t % 600000000000 AS window_start_ns, subject_uuid AS src, dst, event_type, t AS "timestampNanos", size, malicious <> 0 AS malicious
       FROM (SELECT *, unnest([object1_uuid, object2_uuid]) AS dst FROM lh) WHERE dst IS NOT NULL),
md AS (SELECT uuid, count(*) AS degree FROM (SELECT src AS uuid FROM me UNION ALL SELECT dst FROM me) GROUP BY uuid)
"""

_LABEL_COUNTS = "SELECT hostId AS \"hostId\", malicious, count(*) AS n FROM {} GROUP BY ALL"
_CAP_COLUMNS = "window_id, src, dst, event_type, edge_type_id, cnt AS \"count\", first_ts, last_ts, size_sum, size_max"


def _histogram(table: str, column: str, bins: int) -> str:
    return f""", hb AS (SELECT min({column}) - CASE WHEN min({column}) = max({column}) THEN 0.5 ELSE 0.0 END AS lo, max({column}) + CASE WHEN min({column}) = max({column}) THEN 0.5 ELSE 0.0 END AS hi FROM {table}),
hc AS (SELECT CAST(least(floor((CAST({column} AS DOUBLE) - lo) * {bins} / CAST(hi - lo AS DOUBLE)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM {table}, hb GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(CAST(lo AS DOUBLE) + b * (CAST(hi - lo AS DOUBLE) / {bins}), 6) AS lo, coalesce(n, 0) AS n FROM hb, range({bins}) r(b) LEFT JOIN hc ON bin = b"""


def _profile(name: str, table: str, columns: dict) -> str:
    kinds = {c: (k if isinstance(k, tuple) else (k, f'"{c}"')) for c, k in columns.items()}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) - count({expr}) AS n_null FROM {table}" for c, (kind, expr) in kinds.items()
    )


def _blake(text: str, size: int, person: bytes) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=size, person=person).digest()


#: The driver's event types, in order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: SQL has no such hash, so that the bins of the tokens that the driver's tables can have come as values.
_TOKEN_BINS = ", ".join(f"('{t}', {_blake(t, 8, b'cmd')[-1] % 32})" for t in ("usr", "bin", "id", *[f"tool{k}" for k in range(13)], *map(str, range(10, 2000))))
_TOKENS = f", tokens(token, bin) AS (VALUES {_TOKEN_BINS}), cmd AS (SELECT uuid, cid FROM sub WHERE cid % 11 <> 0)"


def _address(text: str) -> int:
    parts = text.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        return int.from_bytes(bytes(map(int, parts)), "big")
    return int.from_bytes(_blake(text, 4, b"ip"), "big")


_FLOW_CODES = ", ".join(
    f"({i}, {_address(f'10.0.0.{i}')}, {_address(f'host{i}.example' if i % 5 == 4 else '' if i % 5 == 3 else f'192.168.1.{i}')})" for i in range(20)
)
_FLOWS = f""", fl(i, here, there) AS (VALUES {_FLOW_CODES}),
nf AS (SELECT window_id, node_idx, dg.uuid, CAST(CAST(here AS FLOAT) AS DOUBLE) AS local_address, CAST(1024 + fl.i AS DOUBLE) AS local_port, CAST(CAST(there AS FLOAT) AS DOUBLE) AS remote_address,
         CASE WHEN fl.i % 4 <> 0 THEN 443.0 ELSE 0.0 END AS remote_port, CAST(6 AS DOUBLE) AS protocol, CAST(deg_in AS DOUBLE) AS deg_in, CAST(deg_out AS DOUBLE) AS deg_out, CAST(deg_in + deg_out AS DOUBLE) AS deg_total
       FROM dg JOIN net ON dg.uuid = net.uuid JOIN fl ON net.i = fl.i WHERE node_type = 'netflow')"""
#: Attributes of the raw records by table.
_RECORD_KEYS = {
    "events": "uuid type timestampNanos subject predicateObject predicateObject2 size", "subjects": "uuid type cid parentSubject localPrincipal startTimestampNanos cmdLine",
    "fileobjects": "uuid type size", "netflows": "uuid localAddress localPort remoteAddress remotePort ipProtocol", "registrykeys": "uuid key", "ipc": "uuid type fd1 fd2",
    "memory": "uuid memoryAddress size",
}
_KEYS = ", k(file, key) AS (VALUES " + ", ".join(f"('{t}', '{k}')" for t, own in _RECORD_KEYS.items() for k in own.split()) + """),
gap AS (SELECT f.file, a.key, row_number() OVER (PARTITION BY a.key ORDER BY f.file) AS r FROM (SELECT DISTINCT file FROM k) f, (SELECT DISTINCT key FROM k) a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = f.file AND k.key = a.key))
SELECT a.key, count(gap.file) AS n_missing, coalesce(string_agg(CASE WHEN r <= 3 THEN gap.file END, ' ' ORDER BY gap.file), '') AS examples FROM (SELECT DISTINCT key FROM k) a LEFT JOIN gap ON a.key = gap.key GROUP BY a.key"""


QUERIES = {
    "label_half_open": _LABEL_COUNTS.format("lh"),
    "label_closed": _LABEL_COUNTS.format("lc"),
    "label_audit": "SELECT hostId AS \"hostId\", count(*) FILTER (coalesce(malicious = 1, false)) AS n_one, count(*) FILTER (NOT coalesce(malicious = 1, false)) AS n_not_one, count(*) FILTER (coalesce(malicious = 0, false)) AS n_zero, count(*) FILTER (NOT coalesce(malicious = 0, false)) AS n_not_zero FROM lh GROUP BY hostId",
    "attack_windows": "SELECT s AS start_ns, e AS end_ns FROM mh",
    "attack_windows_closed": "SELECT s AS start_ns, e AS end_ns FROM mc",
    "attack_windows_ids": "SELECT window_id, host, s AS start_ns, e AS end_ns FROM clos",
    "attack_window_listing": "SELECT window_id AS name, s0 AS start_ns, e0 AS end_ns, strftime(make_timestamp(s0 // 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS start_iso, strftime(make_timestamp(e0 // 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS end_iso, 1 AS malicious, host, CAST(row_number() OVER (PARTITION BY host ORDER BY window_id) - 1 AS INTEGER) AS idx FROM aw",
    "coalesce_half_open": "SELECT s AS start_ns, e AS end_ns FROM mh",
    "coalesce_closed": "SELECT s AS start_ns, e AS end_ns FROM mc",
    "time_bounds": "SELECT lo AS min_ts, hi AS max_ts FROM bd",
    "tumbling_counts": "SELECT * FROM tc",
    "tumbling_counts_stream": "SELECT * FROM tc",
    "benign_windows": "SELECT host, window_start_ns FROM (SELECT hostId AS host, t - t % 600000000000 AS window_start_ns, count(*) AS n FROM lh WHERE malicious = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY host, window_start_ns - window_start_ns % 3600000000000 ORDER BY n DESC, window_start_ns) <= 1",
    "benign_slots": "SELECT s AS start_ns, e AS end_ns FROM s3",
    "benign_sample": "SELECT s AS start_ns, e AS end_ns FROM few",
    "window_tasks": "SELECT window_id, s AS start_ns, e AS end_ns, label FROM tk",
    "event_type_codes": "SELECT * FROM codes",
    "window_events": "SELECT window_id, uuid, t AS \"timestampNanos\" FROM we",
    "edge_aggregate": f"SELECT {_CAP_COLUMNS} FROM ag",
    "edge_score": "SELECT window_id, src, dst, event_type, round(score, 6) AS score FROM sc",
    "edge_cap": f"SELECT {_CAP_COLUMNS}, round(score, 6) AS score FROM kp",
    "window_nodes": "SELECT * FROM wn",
    "node_type_lookup": "SELECT uuid, coalesce((SELECT first(node_type ORDER BY CASE node_type WHEN 'subject' THEN 0 WHEN 'fileobject' THEN 1 ELSE 2 END) FROM ty WHERE ty.uuid = u.uuid), 'unknown') AS node_type FROM (SELECT DISTINCT coalesce(object1_uuid, '') AS uuid FROM ev UNION SELECT coalesce(object2_uuid, '') FROM ev UNION SELECT subject_uuid FROM ev) u",
    "window_build_summary": "SELECT tk.window_id, tk.label, (SELECT count(*) FROM gn WHERE gn.window_id = tk.window_id AND node_type = 'subject') AS \"N_subject\", (SELECT count(*) FROM gn WHERE gn.window_id = tk.window_id AND node_type = 'fileobject') AS \"N_fileobject\", (SELECT count(*) FROM gn WHERE gn.window_id = tk.window_id AND node_type = 'netflow') AS \"N_netflow\", (SELECT count(*) FROM ge WHERE ge.window_id = tk.window_id) AS \"E_total\", NOT EXISTS (SELECT 1 FROM gn WHERE gn.window_id = tk.window_id) AS skipped, CASE WHEN NOT EXISTS (SELECT 1 FROM we WHERE we.window_id = tk.window_id) THEN 'no_events' WHEN NOT EXISTS (SELECT 1 FROM kp WHERE kp.window_id = tk.window_id) THEN 'no_kept_edges' WHEN NOT EXISTS (SELECT 1 FROM gn WHERE gn.window_id = tk.window_id) THEN 'no_nodes' END AS reason FROM tk",
    "graph_nodes": "SELECT * FROM gn",
    "graph_edges": "SELECT window_id, relation, src, dst, event_type, src_idx, dst_idx FROM ge",
    "node_degrees": "SELECT window_id, node_type, node_idx, uuid, deg_in, deg_out, deg_in + deg_out AS deg_total FROM dg",
    "file_type_codes": "SELECT window_id, uuid, file_type, CAST(code AS INTEGER) AS code FROM fc",
    "edge_features": "SELECT window_id, relation, src_idx, dst_idx, CAST(edge_type_id AS DOUBLE) AS type_id, CAST(cnt AS DOUBLE) AS n, "
    + ", ".join(f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4) AS {name}" for name, x in (
        ("span", "least(greatest(CAST(last_ts - first_ts AS DOUBLE) / greatest(e - s, 1), 0.0), 1.0)"), ("pos", "least(greatest(CAST(first_ts - s AS DOUBLE) / greatest(e - s, 1), 0.0), 1.0)"),
        ("log_sum", "ln(1 + CAST(size_sum AS DOUBLE))"), ("log_max", "ln(1 + CAST(size_max AS DOUBLE))"),
    )) + " FROM ge",
    "node_features_file": "SELECT window_id, node_idx, uuid, CAST(code AS DOUBLE) AS code, CAST(deg_in AS DOUBLE) AS deg_in, CAST(deg_out AS DOUBLE) AS deg_out, CAST(deg_in + deg_out AS DOUBLE) AS deg_total FROM fc",
    "graph_integrity": ", sz AS (SELECT window_id, node_type, count(*) AS n FROM gn GROUP BY ALL), en AS (SELECT window_id, src_type AS node_type, src_idx AS i FROM ge UNION ALL SELECT window_id, dst_type, dst_idx FROM ge), ob AS (SELECT en.window_id, count(*) AS n FROM en LEFT JOIN sz ON en.window_id = sz.window_id AND en.node_type = sz.node_type WHERE i >= coalesce(sz.n, 0) GROUP BY en.window_id) SELECT tk.window_id, coalesce((SELECT n FROM ob WHERE ob.window_id = tk.window_id), 0) AS n_out_of_range, NOT EXISTS (SELECT 1 FROM gn WHERE gn.window_id = tk.window_id) AS empty_nodes, NOT EXISTS (SELECT 1 FROM ge WHERE ge.window_id = tk.window_id) AS empty_edges FROM tk",
    "graph_stats": "SELECT * FROM gs",
    "corpus_summary": "SELECT count(*) AS num_graphs, count(*) FILTER (graph_label = 1) AS num_malicious, count(*) FILTER (graph_label = 0) AS num_benign, CAST(sum(total_nodes) AS BIGINT) AS total_nodes_sum, CAST(sum(total_edges) AS BIGINT) AS total_edges_sum, round(avg(total_nodes), 6) AS avg_nodes_per_graph, round(avg(total_edges), 6) AS avg_edges_per_graph, round(avg(CAST(total_edges AS DOUBLE) / nullif(total_nodes, 0)), 6) AS avg_degree_overall, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in ("n_subject", "n_fileobject", "n_netflow", "E_subject_fileobject", "E_subject_netflow", "E_subject_subject", "E_fileobject_subject", "E_netflow_subject")) + " FROM gs",
    "edge_type_freq": "SELECT edge_type_id, count(*) AS n FROM ge GROUP BY edge_type_id ORDER BY n DESC, edge_type_id LIMIT 30",
    "class_weights": "SELECT graph_label, count(*) AS n, round(1.0 / (count(*) + 1e-6), 9) AS weight FROM gs GROUP BY graph_label",
    "dataset_stats": " UNION ALL ".join(f"SELECT '{c}' AS measure, count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM gs" for c in ("total_nodes", "total_edges")),
    "array_stats": "SELECT count(size) AS n, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS std, min(size) AS min, max(size) AS max FROM ev",
    "histogram_nodes": _histogram("gs", "total_nodes", 40),
    "histogram_edges": _histogram("gs", "total_edges", 40),
    "histogram_degree": ", dt AS (SELECT deg_in + deg_out AS d FROM dg)" + _histogram("dt", "d", 50),
    "multigraph_edges": "SELECT * FROM me",
    "top_degree": "SELECT * FROM md ORDER BY degree DESC, uuid LIMIT 10",
    "induced_subgraph": ", top AS (SELECT uuid FROM md ORDER BY degree DESC, uuid LIMIT 50) SELECT * FROM me WHERE src IN (SELECT uuid FROM top) AND dst IN (SELECT uuid FROM top)",
    "first_window_graph": "SELECT * FROM me WHERE window_start_ns = (SELECT min(window_start_ns) FROM me)",
    "parse_events": "SELECT uuid, event_type, t AS \"timestampNanos\", subject_uuid, object1_uuid, object2_uuid, size, hostId AS \"hostId\", 'table' AS source, CAST(1 AS BIGINT) AS \"sessionNumber\" FROM ev",
    "parse_subjects": "SELECT uuid, 'PROCESS' AS subject_type, cid, parent AS \"parentSubject\", started AS \"startTimestampNanos\" FROM sub",
    "parse_fileobjects": "SELECT uuid, nullif(file_type, 'UNK') AS file_type, CAST(substr(uuid, 2) AS BIGINT) AS size FROM fil",
    "parse_netflows": "SELECT uuid, '10.0.0.' || i AS \"localAddress\", CAST(1024 + i AS INTEGER) AS \"localPort\", CASE WHEN i % 4 <> 0 THEN 443 END AS \"remotePort\", 6 AS \"ipProtocol\" FROM net",
    "parse_registry": "SELECT uuid, 'key ' || uuid AS \"key\" FROM net",
    "parse_ipc": "SELECT uuid, 'PIPE' AS ipc_type, CAST(i AS BIGINT) AS fd1, CAST(i + 1 AS BIGINT) AS fd2 FROM net",
    "parse_memory": "SELECT uuid, CAST(4096 * i AS BIGINT) AS \"memoryAddress\", CAST(64 AS BIGINT) AS size FROM net",
    "scan_ndjson": "SELECT (SELECT count(*) FROM ev) + (SELECT count(*) FROM sub) + (SELECT count(*) FROM fil) + 4 * 20 + 2 AS n_lines, (SELECT count(*) FROM ev) + (SELECT count(*) FROM sub) + (SELECT count(*) FROM fil) + 4 * 20 + 1 AS n_parsed",
    "scan_ndjson_files": "SELECT (SELECT count(*) FROM ev) + (SELECT count(*) FROM sub) + (SELECT count(*) FROM fil) + 4 * 20 + 2 AS n_lines, (SELECT count(*) FROM ev) + (SELECT count(*) FROM sub) + (SELECT count(*) FROM fil) + 4 * 20 + 1 AS n_parsed, (SELECT count(*) FROM ev) AS n_events",
    "scan_parquet_folder": f"SELECT count(*) AS n, min(t) AS lo, max(t) AS hi, count(uuid) AS n_uuid FROM ev WHERE t BETWEEN {ATTACKS[0][2]} AND {ATTACKS[5][3]}",
    "multigraph_vertices": ", ve AS (SELECT src AS uuid, \"timestampNanos\" AS t, malicious FROM me UNION ALL SELECT dst, \"timestampNanos\", malicious FROM me), vt AS (SELECT uuid, min(node_type) AS node_type FROM ty GROUP BY uuid) SELECT ve.uuid, coalesce(min(node_type), 'unknown') AS node_type, count(*) AS degree, min(t) AS first_ts, max(t) AS last_ts, bool_or(malicious) AS malicious FROM ve LEFT JOIN vt ON ve.uuid = vt.uuid GROUP BY ve.uuid",
    "record_type_counts": "SELECT 'events' AS record_type, count(*) AS n FROM ev UNION ALL SELECT 'subjects', count(*) FROM sub UNION ALL SELECT 'fileobjects', count(*) FROM fil UNION ALL SELECT x, 20 FROM (VALUES ('netflows'), ('registrykeys'), ('ipc'), ('memory')) v(x) UNION ALL SELECT x, 1 FROM (VALUES ('other'), ('malformed')) v(x)",
    "unwrap_union": "SELECT uuid, subject_uuid AS unwrapped FROM ev",
    "ingest_counts": "SELECT file, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(m) AS BIGINT) AS n_malicious FROM (SELECT hostId || '.json' AS file, 1 AS n, malicious AS m FROM lh) GROUP BY ROLLUP (file)",
    "file_stems": "SELECT DISTINCT hostId AS host, 'run_' || hostId AS stem FROM ev",
    "times_to_ns": "SELECT uuid, t AS from_number, t - t % 1000 AS from_iso FROM ev",
    "homogeneous_edges": "SELECT he.window_id, src, dst, event_type, round(pos, 4) AS pos, label FROM he JOIN (SELECT w.window_id, CAST(EXISTS (SELECT 1 FROM mc WHERE w.s <= mc.e AND mc.s <= w.e) AS INTEGER) AS label FROM tk w) l ON he.window_id = l.window_id",
    "homogeneous_nodes": "SELECT window_id, uuid, node_type, round(in_share, 6) AS in_share, round(out_share, 6) AS out_share, round(total_share, 6) AS total_share FROM hn",
    "homogeneous_node_features": "SELECT window_id, uuid, " + ", ".join(f"CAST(node_type = '{t}' AS DOUBLE) AS is_{t}" for t in ("subject", "fileobject", "netflow"))
    + ", " + ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS {c}" for c in ("in_share", "out_share", "total_share")) + " FROM hn",
    "homogeneous_edge_features": "SELECT window_id, src, dst, " + ", ".join(f"CAST(coalesce(event_type = '{t}', false) AS DOUBLE) AS is_{t}" for t in EVENT_TYPES)
    + ", round(CAST(CAST(pos AS FLOAT) AS DOUBLE), 4) AS pos FROM he",
    "split_assign": "SELECT hostId AS \"hostId\", CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT hostId, CAST('0x' || substr(md5(hostId), 1, 8) AS BIGINT) % 100 AS p FROM (SELECT DISTINCT hostId FROM ev))",
    "node_features_subject": _TOKENS + """, started AS (SELECT uuid, cid, parent, started FROM sub),
words AS (SELECT uuid, 'usr' AS token FROM cmd UNION ALL SELECT uuid, 'bin' FROM cmd UNION ALL SELECT uuid, 'id' FROM cmd UNION ALL SELECT uuid, 'tool' || (cid % 13) FROM cmd UNION ALL SELECT uuid, CAST(cid AS VARCHAR) FROM cmd),
bins AS (SELECT uuid, bin, count(*) AS n FROM words JOIN tokens ON words.token = tokens.token GROUP BY uuid, bin),
every AS (SELECT x.uuid, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY b) AS bins FROM (SELECT uuid, b FROM sub, range(32) r(b)) x LEFT JOIN bins ON x.uuid = bins.uuid AND b = bin GROUP BY x.uuid)
SELECT dg.window_id, node_idx, dg.uuid, CAST(parent IS NOT NULL AS DOUBLE) AS has_parent, CAST(cid % 8 AS DOUBLE) AS cid_mod, CAST(deg_in AS DOUBLE) AS deg_in, CAST(deg_out AS DOUBLE) AS deg_out,
  CAST(deg_in + deg_out AS DOUBLE) AS deg_total, round(CAST(CAST(CASE WHEN started BETWEEN s AND e THEN CAST(started - s AS DOUBLE) / greatest(e - s, 1) ELSE 0.0 END AS FLOAT) AS DOUBLE), 4) AS position, bins
FROM dg JOIN started ON dg.uuid = started.uuid JOIN every ON dg.uuid = every.uuid JOIN tk ON dg.window_id = tk.window_id WHERE node_type = 'subject'""",
    "node_features_netflow": _FLOWS + " SELECT * FROM nf",
    "feature_spread": _FLOWS + """, xs AS (SELECT window_id, unnest([local_address, local_port, remote_address, remote_port, protocol, deg_in, deg_out, deg_total]) AS v FROM nf),
xg AS (SELECT window_id, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_samp(v) AS sd FROM xs GROUP BY window_id)
SELECT CAST(min(lo) AS FLOAT) AS min, CAST(max(hi) AS FLOAT) AS max, round(avg(m), 2) AS mean_of_means, round(avg(sd), 2) AS mean_of_stds FROM xg""",
    "feature_width_check": ", w(feature_set, width, n) AS (SELECT 'subject', 2 + 32 + 1 + 3, (SELECT count(*) FROM gn WHERE node_type = 'subject') UNION ALL SELECT 'fileobject', 1 + 3, (SELECT count(*) FROM gn WHERE node_type = 'fileobject') UNION ALL SELECT 'netflow', 5 + 3, (SELECT count(*) FROM gn WHERE node_type = 'netflow') UNION ALL SELECT 'edge', 2 + 4, (SELECT count(*) FROM ge)) SELECT feature_set, CASE WHEN n > 0 THEN CAST(width AS VARCHAR) ELSE '' END AS widths, true AS consistent, n > 0 AS as_expected FROM w",
    "table_profile": _profile("events", "ev", {"uuid": "string", "event_type": "string", "timestampNanos": ("bigint", "t"), "subject_uuid": "string", "object1_uuid": "string", "object2_uuid": "string", "size": "bigint", "hostId": "string"})
    + " UNION ALL " + _profile("subjects", "sub", {"uuid": "string", "subject_type": ("string", "uuid"), "cid": "bigint", "parentSubject": ("string", "parent"), "localPrincipal": ("string", "uuid"), "startTimestampNanos": ("bigint", "started"), "cmdLine": ("string", "CASE WHEN cid % 11 <> 0 THEN uuid END")}),
    "graph_table_profile": _profile("graph_node", "dg", {"window_id": "string", "node_type": "string", "node_idx": "bigint", "uuid": "string", "deg_in": "bigint", "deg_out": "bigint", "deg_total": ("bigint", "deg_in + deg_out")})
    + " UNION ALL " + _profile("graph_edge", "ge", {
        "window_id": "string", "dst": "string", "src": "string", "event_type": "string", "start_ns": ("bigint", "s"), "end_ns": ("bigint", "e"), "count": ("bigint", "cnt"), "first_ts": "bigint", "last_ts": "bigint", "size_sum": "bigint",
        "size_max": "bigint", "edge_type_id": "bigint", "src_type": "string", "src_idx": "bigint", "dst_type": "string", "dst_idx": "bigint", "relation": "string"}),
    "key_consistency": _KEYS,
}


def oracle_sql() -> dict[str, str]:
    return {name: CHAIN + body for name, body in QUERIES.items() if body}
