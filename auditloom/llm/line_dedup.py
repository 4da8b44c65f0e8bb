"""Line dedup by site-relative frequency.

Pages are documents grouped by host (`source`). For each host and line, the pages that contain the
line are divided by the host's pages and `prior_pages` more that are taken to lack it; lines above
`max_ratio` are that host's boilerplate and are dropped from its pages, every occurrence of them. The
added pages shrink the ratio where a host has few pages, and hardly matter where it has many: on a
host of 5 pages a line must be on 4 of them, on one of 100 on 14, on one of 10,000 on 1,004. With 30
of them and a ratio of 0.1 three pages are never enough, so that two or three copies of a document on
a small host don't pass for boilerplate.

Lines are \\n-split and compared without surrounding white space; blank lines are never counted or
dropped. A line is identified by two 64-bit hashes within its host, so that the shuffle carries 16
bytes a line. A page counts once for a line however often it repeats it.

Defined results: a null text stays null and has no lines; a null host is no site, its pages keep
all lines; repeated rows count as pages of their own; a ratio that ties with the bound is kept; whole
texts of any length are read; extra columns pass through, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import WORD_SPACE, at_most, let, materialize

MAX_RATIO = 0.1
PRIOR_PAGES = 30
#: Boilerplate lines up to these numbers, of all hosts and of one, are broadcast (16 bytes each); beyond them they are joined.
BROADCAST_LINES = 200_000
HOST_LINES = 2_000


def line_key(line: Column) -> Column:
    body = F.btrim(line, F.lit(WORD_SPACE))
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))


def _nonblank(line: Column) -> Column:
    return F.btrim(line, F.lit(WORD_SPACE)) != ""


def _line_keys(text: Column) -> Column:
    """The distinct keys of a text's nonblank lines."""
    return F.array_distinct(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _nonblank), line_key))


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, prior_pages: int = PRIOR_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """One row for each boilerplate line: host, line key, pages with it, pages of the host."""
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counted = (
        pages.select("host", F.explode(_line_keys(F.col("text"))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") / (F.col("pages") + prior_pages) > max_ratio)  # no host has fewer pages; cuts rare lines before the join
    )
    return counted.join(totals, "host").where(F.col("pages") / (F.col("host_pages") + prior_pages) > max_ratio)


def _strip(text: Column, drop: Column) -> Column:
    """The text without the lines whose keys are in `drop`; unchanged where none is."""
    hash_of = lambda line: F.xxhash64(F.btrim(line, F.lit(WORD_SPACE)))

    def without(lines: Column) -> Column:
        # Sets of numbers are compared by hashing; only lines that are found there are looked for by their whole keys.
        some = F.array_intersect(F.transform(lines, hash_of), F.transform(drop, lambda d: d["a"]))

        def kept(hits: Column) -> Column:
            own = F.filter(drop, lambda d: F.array_contains(hits, d["a"]))
            left = let(own, lambda keys: F.filter(lines, lambda line: ~(F.array_contains(hits, hash_of(line)) & _nonblank(line) & F.array_contains(keys, line_key(line)))))
            return F.when(F.size(hits) == 0, text).otherwise(F.array_join(left, "\n"))

        return let(some, kept)

    return F.when(drop.isNull() | text.isNull(), text).otherwise(let(F.split(text, "\n"), without))


def drop_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, prior_pages: int = PRIOR_PAGES, broadcast_lines: int = BROADCAST_LINES, host_lines: int = HOST_LINES) -> DataFrame:
    """Every row with its columns, `text` without boilerplate, and `__was`, the text before.

    The found lines are written to the checkpoint folder and counted. Up to `broadcast_lines`, and up
    to `host_lines` of any host, they go to all executors and texts are not shuffled; more of them are
    joined by line, and what each document has to drop is joined to it.
    """
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("__was"), docs["source"].alias("__host"), docs["doc_id"].alias("__doc")
    )
    found = materialize(boilerplate(docs, max_ratio, prior_pages).select(F.col("host").alias("__h"), F.col("line").alias("__line")))
    sizes = found.groupBy("__h").count()
    if at_most(found, broadcast_lines) and (sizes.agg(F.max("count")).first()[0] or 0) <= host_lines:
        by_host = found.groupBy("__h").agg(F.collect_set("__line").alias("__drop"))
        out = own.join(F.broadcast(by_host), F.col("__host") == F.col("__h"), "left")
    else:
        lines = own.where(F.col("__host").isNotNull()).select(F.col("__host").alias("__h"), "__doc", F.explode(_line_keys(F.col("__was"))).alias("__line"))
        by_doc = (
            lines.join(found, ["__h", "__line"], "left_semi")
            .groupBy("__h", "__doc")
            .agg(F.collect_set("__line").alias("__drop"))
            .withColumnRenamed("__doc", "__doc2")
        )
        out = own.join(by_doc, (F.col("__host") == F.col("__h")) & F.col("__doc").eqNullSafe(F.col("__doc2")), "left")
    stripped = out.select("__row.*", "__was", _strip(F.col("__was"), F.col("__drop")).alias("__text"))
    return stripped.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns], "__was")


def dedup_lines(docs: DataFrame, max_ratio: float = MAX_RATIO, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """The documents with boilerplate lines gone and `n_chars`, if there, brought up to date."""
    out = drop_boilerplate(docs, max_ratio, prior_pages)
    changed = ~F.col("text").eqNullSafe(F.col("__was"))
    cols = [
        F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns
    ]
    return out.select(*cols)


def op3_line_dedup(spark, sf_dir):
    """doc_id, n_lines (nonblank lines before), n_dropped, text (what is left) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    n = lambda text: F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _nonblank)).cast("long")
    return drop_boilerplate(docs).select(
        "doc_id", n(F.col("__was")).alias("n_lines"), (n(F.col("__was")) - n(F.col("text"))).alias("n_dropped"), "text"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, source, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL))),
t AS (SELECT source, count(*) AS n FROM d WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT l.source, body FROM l JOIN t ON l.source = t.source WHERE body <> ''
        GROUP BY l.source, body, n HAVING CAST(count(DISTINCT rid) AS DOUBLE) / (n + 30) > CAST(0.1 AS DOUBLE)),
k AS (SELECT l.rid, l.i, l.line, l.body, bad.body IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source = bad.source AND l.body = bad.body),
a AS (SELECT rid, count(*) FILTER (body <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY rid)
SELECT doc_id, CAST(coalesce(a.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.n_dropped, 0) AS BIGINT) AS n_dropped, a.text
FROM d LEFT JOIN a ON d.rid = a.rid
"""
