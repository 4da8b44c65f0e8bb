"""Small cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions import scalars
from auditloom.operators import edges, graphs, homogeneous, intervals, multigraph, stats, tumbling
from auditloom.sources import avro, records, tables, windows
from auditloom.streaming.tumbling import stream_counts

PAIRS = "start_ns bigint, end_ns bigint"
EVENTS = "uuid string, event_type string, timestampNanos bigint, subject_uuid string, object1_uuid string, object2_uuid string, size bigint, hostId string, malicious int"


def pairs(df):
    return sorted((r["start_ns"], r["end_ns"]) for r in df.collect())


def test_coalesce(spark):
    df = spark.createDataFrame([(100, 200), (200, 300), (400, 400), (500, 450)], PAIRS)
    assert pairs(intervals.coalesce(df)) == [(100, 300)]
    assert pairs(intervals.coalesce(df, closed=True)) == [(100, 300), (400, 400), (450, 500)]
    near = spark.createDataFrame([(1, 5), (6, 9)], PAIRS)
    assert pairs(intervals.coalesce(near)) == [(1, 5), (6, 9)]
    assert pairs(intervals.coalesce(near, closed=True)) == [(1, 9)]
    assert pairs(intervals.coalesce(spark.createDataFrame([(1, 100), (5, 10), (50, 60)], PAIRS))) == [(1, 100)]
    assert pairs(intervals.coalesce(spark.createDataFrame([], PAIRS))) == []


def test_labels(spark):
    win = spark.createDataFrame([(100, 200), (200, 300), (400, 400), (500, 450)], PAIRS)
    ev = spark.createDataFrame([(t,) for t in (99, 100, 200, 299, 300, 301, 400, 450, 500, None)], "timestampNanos bigint")
    for closed, ones in ((False, {100, 200, 299}), (True, {100, 200, 299, 300, 400, 450, 500})):
        got = {r["timestampNanos"]: r["malicious"] for r in intervals.label(ev, win, closed, bin_ns=7).collect()}
        assert len(got) == 9 and {t for t, m in got.items() if m} == ones


def test_buckets(spark):
    df = spark.createDataFrame([(1557410399999999999,), (-1,)], "t bigint").select(scalars.bucket(F.col("t"), 600_000_000_000).alias("b"))
    assert [r["b"] for r in df.collect()] == [1557409800000000000, -600_000_000_000]


def test_busiest_window_ties_and_null_host(spark):
    w = 600_000_000_000
    rows = [("h", k * w + j) for k, n in ((0, 5), (1, 7), (2, 7)) for j in range(n)] + [(None, 3)]
    df = spark.createDataFrame(rows, "hostId string, timestampNanos bigint")
    assert sorted(map(tuple, tumbling.busiest_windows(df).collect())) == [("UNKNOWN", 0), ("h", w)]


def _walk(lo, hi, attacks, w):
    merged = []
    for s, e in sorted(attacks):
        if merged and s <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, at = [], lo
    while at + w <= hi:
        hit = next((m for m in merged if m[0] <= at + w and m[1] >= at), None)
        if hit:
            at = hit[1] + 1
        else:
            out.append((at, at + w))
            at += w + 1
    return out


def test_slots(spark):
    rnd = random.Random(4)
    cases = [(0, 30, [(8, 12)], 4)]
    for _ in range(6):
        cases.append((rnd.randint(0, 20), rnd.randint(60, 120), [(s, s + rnd.randint(0, 12)) for s in rnd.sample(range(130), rnd.randint(0, 6))], rnd.randint(1, 7)))
    for lo, hi, attacks, w in cases:
        bounds = spark.createDataFrame([(lo, hi)], "min_ts bigint, max_ts bigint")
        assert pairs(intervals.free_slots(bounds, spark.createDataFrame(attacks, PAIRS), w)) == _walk(lo, hi, attacks, w), (lo, hi, attacks, w)
    assert [s for s, _ in _walk(*cases[0])] == [0, 13, 18, 23]


def test_even_sample(spark):
    def picked(n, k):
        df = spark.range(n).select(F.col("id").alias("start_ns"), F.col("id").alias("end_ns"))
        return [s for s, _ in pairs(intervals.even_sample(df, k))]

    assert picked(10, 4) == [0, 3, 6, 9]
    assert picked(3, 5) == [0, 1, 2]
    assert picked(1009, 1000)[111] == 111


def _edges(spark, rows):
    return spark.createDataFrame(rows, "window_id string, src string, dst string, event_type string, edge_type_id bigint, score double")


def test_edge_ends_and_score(spark):
    ev = spark.createDataFrame([("e1", "A", 0, "s", "a", None, 99, "h", 0), ("e2", "A", 1000, "s", "a", "b", None, "h", 0), ("e3", None, 5, "s", "a", None, 1, "h", 0)], EVENTS)
    win = spark.createDataFrame([("w", 0, 2000)], "window_id string, start_ns bigint, end_ns bigint")
    ag = edges.aggregate(intervals.in_windows(ev, win, bin_ns=300), edges.event_type_codes(ev))
    got = {(r["dst"], r["event_type"]): (r["count"], r["size_sum"], r["edge_type_id"]) for r in ag.collect()}
    assert got == {("a", "A"): (1, 99, 0), ("b", "A"): (1, 0, 0), ("a", None): (1, 1, 0)}
    score = spark.range(1).select(scalars.edge_score(F.lit(4), F.lit(99), F.lit(1000)).alias("s")).first()["s"]
    assert score == pytest.approx(2.347614, abs=1e-6)


def test_edge_cap(spark):
    def kept(rows):
        return sorted((r["src"], r["dst"]) for r in edges.cap(_edges(spark, [("w", s, d, "T", 0, x) for s, d, x in rows])).collect())

    assert kept([("s1", "f1", 3.0), ("s1", "f2", 2.0), ("s2", "f2", 5.0)]) == [("s1", "f1"), ("s2", "f2")]
    assert len(kept([("s1", "f1", 3.0), ("s1", "f2", 2.0), ("s2", "f2", 1.0)])) == 3
    assert kept([("s1", "f1", 2.0), ("s1", "f2", 2.0), ("s2", "f2", 5.0)]) == [("s1", "f1"), ("s2", "f2")]
    assert kept([("s1", "f1", None), ("s1", "f2", 1.0)]) == [("s1", "f1"), ("s1", "f2")]


def test_codes(spark):
    ev = spark.createDataFrame([("C",), ("A",), (None,), ("B",), ("A",)], "event_type string")
    assert sorted(map(tuple, edges.event_type_codes(ev).collect())) == [("A", 0), ("B", 1), ("C", 2)]
    nodes = spark.createDataFrame([("w1", "fileobject", x) for x in "abc"] + [("w2", "fileobject", "a")], "window_id string, node_type string, uuid string")
    files = spark.createDataFrame([("a", "FILE"), ("b", "DIR"), ("c", None)], "uuid string, file_type string")
    got = {(r["window_id"], r["file_type"]): r["code"] for r in graphs.file_type_codes(nodes, files).collect()}
    assert got == {("w1", "DIR"): 1, ("w1", "FILE"): 2, ("w1", "UNK"): 3, ("w2", "FILE"): 1}


def test_token_sketch(spark):
    df = spark.createDataFrame([("firefox cmd EXE x",), ("/usr/dir",), ("",), (None,)], "c string").select(scalars.token_sketch(F.col("c")).alias("x"))
    got = [{k for k, v in enumerate(r["x"]) if v} for r in df.collect()]
    assert got == [{3, 10, 1}, {20, 25}, set(), set()]


def test_address_codes(spark):
    df = spark.createDataFrame([("192.168.1.1",), ("",), (None,), ("example.com",), ("::1",), ("1.2.3.400",)], "a string")
    got = [r["n"] for r in df.select(scalars.address_code(F.col("a")).alias("n")).collect()]
    assert got[:5] == [3232235777, 2604770341, 2604770341, 1863029796, 945947032] and got[5] != 16909456


def test_positions(spark):
    end = 180_000_000_000
    df = spark.createDataFrame([(end // 2,), (-1,), (end + 1,), (None,), (0,), (end,)], "v bigint")
    assert [r["p"] for r in df.select(scalars.relative_position(F.col("v"), F.lit(0), F.lit(end)).alias("p")).collect()] == [0.5, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_degrees(spark):
    nodes = spark.createDataFrame([("w", "subject", "s1", 0), ("w", "subject", "s2", 1), ("w", "fileobject", "f1", 0)], "window_id string, node_type string, uuid string, node_idx bigint")
    kept = spark.createDataFrame([("w", "s1", "f1"), ("w", "s1", "s2"), ("w", "f1", "s1"), ("w", "f1", "f1")], "window_id string, src string, dst string")
    typed = graphs.graph_edges(kept, nodes)
    assert typed.count() == 3
    got = {r["uuid"]: (r["deg_in"], r["deg_out"], r["deg_total"]) for r in graphs.node_degrees(nodes, typed).collect()}
    assert got == {"s1": (1, 2, 3), "s2": (1, 0, 1), "f1": (1, 1, 2)}


def test_homogeneous(spark):
    win = spark.createDataFrame([("w", 0, 10), ("v", 20, 30)], "window_id string, start_ns bigint, end_ns bigint")
    marked = homogeneous.label_by_overlap(win, spark.createDataFrame([(10, 12), (40, 50)], PAIRS))
    assert {r["window_id"]: r["label"] for r in marked.collect()} == {"w": 1, "v": 0}
    ev = spark.createDataFrame([("e1", "A", 0, "s", "a", None, 9, "h", 0), ("e2", "B", 5, "s", "a", "b", 1, "h", 0), ("e3", "A", 7, "a", "s", None, 1, "h", 0)], EVENTS)
    rows = homogeneous.edges(intervals.in_windows(ev, win), marked, max_edges=2)
    got = {r["dst"]: [round(x, 3) for x in r["edge_attr"]] for r in homogeneous.edge_features(rows, ["A", "B"]).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0.5]}
    types = spark.createDataFrame([("s", "subject"), ("a", "fileobject")], "uuid string, node_type string")
    x = {r["uuid"]: list(r["x"]) for r in homogeneous.node_features(homogeneous.nodes(rows, types)).collect()}
    assert x == {"s": [1, 0, 0, 0, 1, 1], "a": [0, 1, 0, 0.5, 0, 0.5], "b": [0, 0, 0, 0.5, 0, 0.5]}


def test_homogeneous_cap_across_slices(spark):
    rnd = random.Random(9)
    ev = spark.createDataFrame([(f"e{k:03}", "A", rnd.randrange(1000), "s", "a", None, 1, "h", 0) for k in range(300)], EVENTS)
    win = spark.createDataFrame([("w", 0, 1000), ("v", 100, 130), ("z", 7, 7)], "window_id string, start_ns bigint, end_ns bigint").withColumn("label", F.lit(0))
    held = intervals.in_windows(ev, win)
    for cap, slices in ((10, 4), (37, 256), (1000, 8)):
        got, want = {}, {}
        for r in homogeneous.edges(held, win, max_edges=cap, slices=slices).collect():
            got.setdefault(r["window_id"], []).append(r["pos"])
        for r in sorted(held.collect(), key=lambda r: (r["window_id"], r["timestampNanos"], r["uuid"])):
            own = want.setdefault(r["window_id"], [])
            if len(own) < cap:
                own.append((r["timestampNanos"] - r["start_ns"]) / max(r["end_ns"] - r["start_ns"], 1))
        assert {w: sorted(x) for w, x in got.items()} == {w: sorted(x) for w, x in want.items()}


def test_places_in_order(spark):
    rnd = random.Random(1)
    names = sorted({"".join(rnd.choice("ab0é") for _ in range(rnd.randint(0, 9))) for _ in range(200)}, key=lambda x: x.encode())
    df = spark.createDataFrame([(g, x) for g in "pq" for x in names], "g string, uuid string")
    for letters in (1, 3):
        got = {(r["g"], r["uuid"]): r["place"] for r in graphs.in_order(df, ["g"], "uuid", letters).collect()}
        assert got == {(g, x): k for g in "pq" for k, x in enumerate(names)}


def test_one_row_whichever_order(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", None, "z"), (None, 1, "y")], "uuid string, n int, t string")
    assert [tuple(r) for r in graphs.one_row(df).collect()] == [tuple(r) for r in graphs.one_row(df.orderBy(F.desc("n"))).collect()] == [("a", 2, "x")]


def test_flags_and_iso(spark):
    df = spark.createDataFrame([(x,) for x in ("0", "1", "true", "false", "x", None)], "v string")
    assert [r[0] for r in df.select(scalars.as_flag(F.col("v"))).collect()] == [0, 1, 1, 0, 1, 1]
    assert spark.range(1).select(scalars.iso_from_ns(F.lit(1557410220999999999))).first()[0] == "2019-05-09T13:57:00+00:00"


def test_label_audit(spark):
    r = tumbling.label_audit(spark.createDataFrame([(1,), (0,), (None,)], "malicious int")).first()
    assert tuple(r) == (1, 2, 1, 2)


def test_mean_of_ratios(spark):
    cols = ["total_nodes", "total_edges", "graph_label", "n_subject", "n_fileobject", "n_netflow"] + ["E_" + "_".join(r) for r in graphs.RELATIONS]
    df = spark.createDataFrame([(n, e, 0, *[0] * 8) for n, e in ((1, 2), (0, 0), (1, 1))], ", ".join(f"{c} bigint" for c in cols))
    assert stats.corpus_summary(df).first()["avg_degree_overall"] == 1.5


def test_times(spark):
    texts = ["1557410399999999999", "1557410220.5", "1.5e18", "2019-05-09T13:57Z", "2019-05-09T13:57:00+00:00", "x", None]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.to_ns(F.col("t")).alias("n")).collect()]
    assert got == [1557410399999999999, 1557410220500000000, 1500000000000000000, 1557410220000000000, 1557410220000000000, None, None]
    assert [windows.nanoseconds(x) for x in (5, 1557410220.5, "7", "2019-05-09T13:57Z", "x", None)] == [5, 1557410220500000000, 7, 1557410220000000000, None, None]


def test_records(spark, tmp_path):
    p = "com.bbn.tc.schema.avro.cdm20."
    lines = [
        {"datum": {p + "Event": {"uuid": "e1", "type": "EVENT_READ", "timestampNanos": 1557410220000000000, "subject": {p + "UUID": "s1"}, "predicateObject": {p + "UUID": "f1"}, "predicateObject2": None, "size": {"long": 5}}}, "hostId": "h1", "source": "SRC", "sessionNumber": 1},
        {"datum": {p + "Event": {"uuid": "e2", "type": "EVENT_OPEN", "tsNanos": {"long": 1557410400000000000}, "subject": "s1"}}, "hostId": None},
        {"datum": {p + "Event": {"uuid": "e3", "type": "EVENT_OPEN", "timestampNanos": "x", "time": "1557410399999999999"}}},
        {"datum": {p + "Event": {"uuid": "e4", "type": "EVENT_OPEN"}}},
        {"datum": {p + "NetFlowObject": {"uuid": "n1", "localAddress": {"string": "10.0.0.1"}, "localPort": {"int": 80}}}},
        {"datum": {p + "Host": {"uuid": "h1"}}},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n\n")
    raw = records.read_lines(spark, str(tmp_path / "a.json"))
    assert raw.count() == 7 and records.read_lines(spark, str(tmp_path / "a.json"), braces_only=True).count() == 6
    parsed = records.records(raw)
    got = {r["uuid"]: r for r in records.parse_events(parsed).collect()}
    assert set(got) == {"e1", "e2", "e3"}
    assert (got["e1"]["subject_uuid"], got["e1"]["object1_uuid"], got["e1"]["object2_uuid"], got["e1"]["size"]) == ("s1", "f1", None, 5)
    assert got["e3"]["timestampNanos"] == 1557410399999999999 and got["e2"]["subject_uuid"] == "s1"
    flow = records.parse_netflows(parsed).first()
    assert (flow["localAddress"], flow["localPort"], flow["remotePort"]) == ("10.0.0.1", 80, None)
    kinds = {r["record_type"]: r["n"] for r in records.record_type_counts(parsed).collect()}
    assert kinds == {"events": 4, "netflows": 1, "other": 1, "malformed": 1}
    win = spark.createDataFrame([(1557410220000000000, 1557410400000000000)], PAIRS)
    assert {r["uuid"]: r["malicious"] for r in intervals.label(records.parse_events(parsed), win).collect()} == {"e1": 1, "e2": 0, "e3": 1}


def test_window_layouts(spark, tmp_path):
    a = {"attacks_by_host": {"h": [{"start_ns": 1, "end_ns": 5}, {"start_ns": 7, "end_ns": 7}, {"start_ns": "x", "end_ns": 2}]}}
    assert windows.half_open(a) == [(1, 5)] and windows.closed(a) == [(1, 5), (7, 7)]
    assert windows.half_open({"attacks": [{"window": {"start_unix_ns": 1, "end_unix_ns": 3}}]}) == [(1, 3)]
    assert windows.half_open({"intervals": [[1, 2], [3]]}) == [(1, 2)]
    assert windows.half_open([{"start_ns": 1, "end_ns": 2}, {"window": {"start_unix_ns": 4, "end_unix_ns": 6}}]) == [(1, 2), (4, 6)]
    with pytest.raises(ValueError):
        windows.closed({})
    assert windows.with_ids({"attacks_by_host": {"h": [{"start_iso": "2019-05-09T13:57Z", "end": 5, "id": "z"}]}})[0][2:] == (5, 1557410220000000000)
    assert [w[0] for w in windows.with_ids(a)] == ["h_attack_0", "h_attack_1"]
    row = windows.listing([{"start_ns": 1557410220000000000, "malicious": False}])[0]
    assert (row["name"], row["start_iso"], row["end_ns"], row["malicious"]) == ("attack_0", "2019-05-09T13:57:00+00:00", None, 0)
    (tmp_path / "w.json").write_text(json.dumps(a))
    assert windows.read_json(spark, str(tmp_path / "w.json")) == a


def test_schema_names(spark, tmp_path):
    kind = {"type": "enum", "name": "Kind", "symbols": ["A", "B"]}
    inner = {"type": "record", "name": "Inner", "fields": [{"name": "k", "type": kind}]}
    doc = [{"type": "record", "name": "Outer", "fields": [{"name": "x", "type": ["null", inner]}, {"name": "y", "type": {"type": "array", "items": "Kind"}}]}]
    (tmp_path / "s.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in avro.schema_table(spark, str(tmp_path / "s.json")).collect()] == [("enum", "Kind", ["A", "B"]), ("record", "Inner", ["k"]), ("record", "Outer", ["x", "y"])]
    names, rows = tables.inspect(spark.range(5), 2)
    assert names == [("id", "bigint")] and rows.count() == 2


def test_multigraph(spark):
    ev = spark.createDataFrame([("e1", "A", 5, "s", "a", "b", 1, "h", 1), ("e2", "A", 6, "s", "s", "", 1, "h", None), ("e3", "A", 700_000_000_000, "s", "a", None, 1, "h", 0)], EVENTS)
    e = multigraph.edges(ev)
    assert e.count() == 4 and multigraph.first_window(e).count() == 3
    assert {r["uuid"]: r["degree"] for r in multigraph.degrees(e).collect()} == {"s": 5, "a": 2, "b": 1}
    assert multigraph.induced_subgraph(e, 2).count() == 3


def test_key_consistency(spark):
    df = spark.createDataFrame([("f1", ["a", "b"]), ("f2", ["a"]), ("f3", ["a"])], "file string, keys array<string>")
    assert {r["key"]: (r["n_missing"], r["examples"]) for r in stats.key_consistency(df).collect()} == {"a": (0, []), "b": (2, ["f2", "f3"])}


def test_histogram_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10, 10)], "v double")
    assert [r["n"] for r in stats.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 1, 0, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a b.json.3", 1), ("c.json", 2)], "file string, n int")
    tables.write_table(df, str(tmp_path / "t"), by_file="file", rows_per_file=1)
    assert sorted(p.name for p in (tmp_path / "t").glob("file_stem=*")) == ["file_stem=a_b", "file_stem=c"]
    assert tables.scan(spark, str(tmp_path / "t"), ["n", "missing"]).columns == ["n"]
    assert tables.scan(spark, str(tmp_path / "t"), ["n"], where=F.col("n") > 1, name_prefix="PART").count() == 1
    tables.write_relabelled(df, str(tmp_path / "r"))
    tables.write_relabelled(df.limit(0), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    tables.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0])["n"] in (1, 2)
    nodes = spark.createDataFrame([("w", "x")], "window_id string, uuid string")
    tables.write_graphs(nodes, nodes, spark.createDataFrame([("w", 1)], "window_id string, label int"), str(tmp_path / "g"))
    assert (tmp_path / "g" / "graph_node" / "label=1").exists()


def test_relabelled_files(spark, tmp_path):
    for name, rows in (("a", [(1, 5)]), ("b", [(2, 50)])):
        spark.createDataFrame(rows, "uuid int, timestampNanos bigint").write.parquet(str(tmp_path / name))
    spark.range(3).write.parquet(str(tmp_path / "c"))
    win = spark.createDataFrame([(0, 10)], PAIRS)
    inputs = {str(tmp_path / x): str(tmp_path / f"{x}_out") for x in "abc"}
    label = lambda df: intervals.label(df, win, closed=True)
    assert [x for _, x in tables.relabel_files(spark, inputs, label, ["timestampNanos"])] == ["written", "written", "lacks timestampNanos"]
    assert [x for _, x in tables.relabel_files(spark, inputs, label, ["timestampNanos"])] == ["there", "there", "lacks timestampNanos"]
    assert [spark.read.parquet(str(tmp_path / f"{x}_out")).first()["malicious"] for x in "ab"] == [1, 0]
    kept, passed = tables.scan_required(spark, [str(tmp_path / x) for x in "abc"], ["timestampNanos"], drop=["uuid"])
    assert kept.columns == ["timestampNanos"] and kept.count() == 2 and [lacks for _, lacks in passed] == [["timestampNanos"]]
    wrapped = windows.listing([{"start_ns": {"long": 5}, "end_ns": {"long": "9"}}])[0]
    assert (wrapped["start_ns"], wrapped["end_ns"]) == (5, 9)
    ev = spark.createDataFrame([("e1", "A", 5, "s", "a", "b", 1, "h", 1)], EVENTS)
    e = multigraph.edges(ev)
    tables.write_multigraph(e, multigraph.vertices(e, spark.createDataFrame([("s", "subject")], "uuid string, node_type string")), str(tmp_path / "m"))
    assert {(r["uuid"], r["node_type"], r["degree"]) for r in spark.read.parquet(str(tmp_path / "m" / "vertex")).collect()} == {("s", "subject", 2), ("a", "unknown", 1), ("b", "unknown", 1)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("h", 5), ("h", 600_000_000_001), (None, 7), ("h", 900_000_000_000)]
    df = spark.createDataFrame(rows, "hostId string, timestampNanos bigint")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_counts(source).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, tumbling.tumbling_counts(df).collect()))
