"""Quality rules: per-document rules, and verdicts on hosts whose documents fail them too often.

A document fails the base rules when it has too few words or when too many of its words lie in
repeated word windows. Failures are aggregated by host (the `source` column); each host's failure
rate is shrunk towards the corpus by a beta prior, so that a host with few documents needs stronger
evidence. The prior's mean is the corpus' rate; its strength comes from the spread between the hosts'
rates, weighted by documents and less the spread that drawing so many documents from equal hosts
would give (moments of the beta-binomial), held between 1 and `FLAT_PRIOR` pseudo-documents. Hosts
whose shrunk rate exceeds `max_host_rate` are rejected, and the verdict is joined back.

Defined results: a null or blank text has no words and fails; a null host is no host, so only the
document's own rules decide; repeated rows are judged one by one; a rate that ties with the bound is
kept; whole texts of any length are read; an empty table gives no rows; columns besides the ones named
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import WORD_BREAK, broadcast_if_small, let, materialize, stored, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
MAX_HOST_RATE = 0.5
#: Pseudo-documents of the prior when hosts differ no more than by chance; its most.
FLAT_PRIOR = 1000.0


def repeated_words(words: Column, width: int = WINDOW_WORDS) -> Column:
    """How many words lie in a `width`-word window that occurs twice or more in the array.

    Windows are compared by a 64-bit hash inside one document. Sorting happens only for the
    documents that have a repeated window at all; no step is worse than n log n in the words.
    """

    def hashes(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.xxhash64(F.slice(ws, i, width)))

    def covered(hs: Column) -> Column:
        rows = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(
            rows,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return let(
            starts,
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(ps, i + 1) - p, F.lit(width)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    def counted(ws: Column) -> Column:
        some = let(hashes(ws), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))
        return F.when(F.size(ws) > width, some).otherwise(F.lit(0))

    return let(words, counted)  # bound, so that no plan splits the text again for each window


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures and `base_failed` to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    nonblank = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    return (
        docs.withColumn("__words", words_of(F.col(text)))
        .withColumn("__lines", nonblank)
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(body, WORD_BREAK, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("__words")).cast("long"))
        .drop("__words", "__lines")
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def prior(hosts: int, docs: float | None, squares: float | None, failed: float | None, spread: float | None) -> tuple[float, float]:
    """Mean and pseudo-documents of the beta prior, from the hosts' sums of 1, n, n * n, k and k * k / n (n documents, k failed)."""
    mean = failed / docs if docs else 0.0
    if not 0 < mean < 1:
        return mean, FLAT_PRIOR
    between = (spread - failed * mean) / (mean * (1 - mean)) - (hosts - 1)
    most = docs - squares / docs - (hosts - 1)
    share = between / most if most > 0 else 0.0
    return mean, min(max(1 / share - 1, 1.0), FLAT_PRIOR) if share > 0 else FLAT_PRIOR


def host_verdicts(judged: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, prior, shrunk rate, rejected. Needs `base_failed`."""
    hosts = materialize(
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    mean, strength = prior(*hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(n * n), F.sum(k), F.sum(k * k / n)).first())  # five numbers
    alpha, beta = mean * strength, (1 - mean) * strength
    shrunk = (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta)
    return hosts.select(
        "host", "n_docs", "n_failed", F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), shrunk.alias("shrunk_rate"),
        (shrunk > max_host_rate).alias("host_rejected"),
    )


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures and verdicts of every document: doc_id, source, base measures, host_rejected, kept.

    The measures are written to the checkpoint folder once (a few numbers for each document), as
    both the hosts' totals and the result need them.
    """
    base = materialize(base_rules(docs.select("doc_id", "text", "source")).drop("text"))
    verdicts = host_verdicts(base, max_host_rate=max_host_rate).select(F.col("host").alias("__host"), "host_rejected")
    return (
        base.join(verdicts, base["source"] == verdicts["__host"], "left")
        .drop("__host")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep_good(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with all their columns. The rules run once: what passes them is written with its text, of the rest the host alone."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("__text"), docs["source"].alias("__source"))
    judged = base_rules(own, "__text").select("__source", "base_failed", F.when(~F.col("base_failed"), F.col("__row")).alias("__row"))
    judged = stored(judged)
    verdicts = host_verdicts(judged.select(F.col("__source").alias("source"), "base_failed"), max_host_rate=max_host_rate)
    rejected = broadcast_if_small(materialize(verdicts.where("host_rejected").select(F.col("host").alias("__host"))))
    return judged.where(~F.col("base_failed")).join(rejected, F.col("__source") == F.col("__host"), "left_anti").select("__row.*")


def op1_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, p, list_slice(ws, p, p + 7) AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS i FROM twice) GROUP BY rid),
b AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM b),
h AS (SELECT source AS host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT CAST(count(*) AS DOUBLE) AS c, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(n AS DOUBLE) * n) AS q, CAST(sum(k) AS DOUBLE) AS k, sum(CAST(k AS DOUBLE) * k / n) AS r FROM h),
e AS (SELECT CASE WHEN n > 0 THEN k / n ELSE 0.0 END AS mu, c, n, q, k, r FROM m),
sh AS (SELECT mu, CASE WHEN mu > 0 AND mu < 1 AND n - q / n - (c - 1) > 0 THEN ((r - k * mu) / (mu * (1 - mu)) - (c - 1)) / (n - q / n - (c - 1)) ELSE 0.0 END AS rho FROM e),
pr AS (SELECT mu, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM sh),
vd AS (SELECT host, (k + mu * s) / (n + s) > 0.5 AS rejected FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected
FROM f LEFT JOIN vd ON f.source = vd.host
"""
