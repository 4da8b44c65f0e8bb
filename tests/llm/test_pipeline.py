import hashlib
from array import array

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import bpe, quality_rules
from tests.llm import brute


def brute_pipeline(rows, items):
    """doc_id and ids of what the five stages keep, in plain Python; rows of the documents table."""
    passed = [(d, t) for d, _, t, ok in rows if ok]
    source = {d: s for d, s, _, _ in rows}
    pages, seen = {}, {}
    for d, t in passed:
        pages[source[d]] = pages.get(source[d], 0) + 1
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")} - {""}:
            seen[source[d], line] = seen.get((source[d], line), 0) + 1
    bad = {k for k, n in seen.items() if n / (pages[k[0]] + 30) > 0.1}
    stripped = [(d, "\n".join(x for x in t.split("\n") if (source[d], x.strip(" \t\n\x0b\x0c\r")) not in bad)) for d, t in passed]
    stay = set(brute.kept_ids(stripped))
    one = [(d, t) for d, t in stripped if d in stay]
    leaks = {d for d, _ in brute.overlaps(one, items)}
    codec = bpe.Codec(bpe.load(bpe.default_path()))
    return sorted((d, array("I", codec.encode(t)).tolist()) for d, t in one if d not in leaks)


def test_pipeline(spark, sf):
    verdict = duckdb.connect()
    verdict.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = verdict.sql(f"SELECT d.doc_id, d.source, d.text, q.kept FROM documents d JOIN ({quality_rules.SQL}) q ON d.doc_id = q.doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == brute_pipeline(rows, items)
    assert all(r["ids_sha256"] == hashlib.sha256(array("I", r["ids"]).tobytes()).hexdigest() for r in got)


def test_stages_on_edges(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    data = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", None, 0), (3, " ".join(f"w{k}" for k in range(60)), None, "b", 9)]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "bpe" or out.columns == docs.columns
            out.count()


def test_stages_with_long_texts_ties_and_clashing_columns(spark, sf):
    """Extra columns named like the stages' own ones pass through; equal rows, equal texts and a very long text don't crash."""
    own = spark.read.parquet(f"{sf}/documents.parquet")
    extra = ("fp", "component_id", "key", "n", "host", "line", "kept", "band", "id", "root", "item_id")
    plain = " ".join(f"word{k}" for k in range(80))
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, plain, "a"), (2, plain, "a"), (3, long, "b"), (3, long, "b"), (4, f"{plain} tail", "a"), (5, None, None), (6, "", "b"), (None, plain, None)]
    kinds = dict(own.dtypes)
    narrow = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = narrow.select(*[narrow[c] if c in narrow.columns else filled(kinds[c], c) for c in own.columns], *[filled("string", c, "x") for c in extra])
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "bpe" or out.columns == docs.columns
        kept[name] = out.collect()
    assert sorted(r["doc_id"] for r in kept["simhash_near_dedup"] if r["doc_id"] is not None) == [1, 3, 5]
    assert all(r[c] == "x" for r in kept["simhash_near_dedup"] for c in extra)
    assert len(kept["bpe"]) == len(rows)


def filled(kind, name, value=None):
    return F.lit(value).cast(kind).alias(name)
