"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case tokens of letters and digits. Two fixed masks are laid on every token
position; each hashes the tokens under its set positions and ignores the others, so a substituted
token under a gap does not matter. Equal hashes of a document and a benchmark item name a diagonal
(document position minus item position), and each diagonal is then verified token by token.

A document holds an item when, on some diagonal, at least 11 tokens agree within 13 consecutive
tokens of the item (items of 7 to 12 tokens: all tokens agree). The masks have weight 6 and spans
7 and 9: whichever two of 13 tokens are substituted, one of the masks still fits somewhere between
them (checked over all cases in the tests), so seeding loses no such overlap.

Defined results: null or short texts hold nothing; benchmark items of fewer than 7 tokens or without
an item_id can't be matched; rows with the same doc_id count as one document; repeated benchmark items are reported
under each item_id; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import at_most, broadcast_if_small, materialize

MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
WINDOW = 13
WINDOW_MATCHES = 11
MIN_ITEM_TOKENS = 7
#: Benchmark seeds (8 bytes each) are broadcast up to this number, and shuffled beyond it.
BROADCAST_SEEDS = 1_000_000


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def seeds(table: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each position and mask that fits there: keys, pos, seed."""
    span = max(m[-1] for m in MASKS) + 1
    hashes = F.transform(tokens_of(F.col(text)), lambda w: F.xxhash64(w))
    shifted = F.arrays_zip(*[(F.col("__h") if k == 0 else F.slice("__h", k + 1, F.greatest(F.size("__h") - k, F.lit(0)))).alias(f"t{k}") for k in range(span)])
    rows = table.select(*keys, hashes.alias("__h")).where(F.size("__h") >= MIN_ITEM_TOKENS).select(*keys, F.posexplode(shifted).alias("pos", "t"))
    hashed = [
        F.when(F.col(f"t.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"t.t{k}") for k in m])) for i, m in enumerate(MASKS)
    ]
    return rows.select(*keys, "pos", F.explode(F.array(*hashed)).alias("seed")).where(F.col("seed").isNotNull())


def _verified(item: Column, doc: Column, diagonal: Column) -> Column:
    """Tokens of the item that agree along the diagonal, or null where no window has enough of them."""
    n = F.size(item)
    width = F.least(n, F.lit(WINDOW))
    need = F.when(n >= WINDOW, F.lit(WINDOW_MATCHES)).otherwise(n)
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(F.get(doc, diagonal + j) == F.get(item, j), F.lit(False)))

    def close(m: Column) -> Column:
        some = F.exists(F.sequence(F.lit(0), F.greatest(F.size(m) - need, F.lit(0))), lambda i: F.get(m, i + need - 1) - F.get(m, i) < width)
        return F.when((F.size(m) >= need) & some, F.size(m))

    return F.transform(F.array(hits), close)[0]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row for each document and benchmark item it holds: doc_id, item_id, n_item_tokens, n_matched."""
    docs, items = docs.select("doc_id", "text"), benchmark.where("item_id IS NOT NULL").select("item_id", F.col("text").alias("item_text"))
    bench = materialize(seeds(items, ["item_id"], "item_text").withColumnRenamed("pos", "item_pos"))
    known = bench.select("seed").distinct()
    if at_most(known, broadcast_seeds):
        known, bench = F.broadcast(known), F.broadcast(bench) if at_most(bench, broadcast_seeds) else bench
    hits = seeds(docs, ["doc_id"], "text").join(known, "seed", "left_semi")
    diagonals = materialize(hits.join(bench, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct())
    item_tokens = items.select("item_id", tokens_of(F.col("item_text")).alias("item_tokens"))
    held = diagonals.join(item_tokens, "item_id").select(F.col("doc_id").alias("__doc"), "item_id", "item_tokens", "diagonal")
    hit = broadcast_if_small(materialize(diagonals.select(F.col("doc_id").alias("__hit")).distinct()))
    few = docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_semi")  # the other texts stay where they are
    return (
        few.select("doc_id", tokens_of(F.col("text")).alias("doc_tokens"))
        .join(held, F.col("doc_id").eqNullSafe(F.col("__doc")))
        .select(
            "doc_id", "item_id", F.size("item_tokens").cast("long").alias("n_item_tokens"),
            _verified(F.col("item_tokens"), F.col("doc_tokens"), F.col("diagonal")).cast("long").alias("matched"),
        )
        .where(F.col("matched").isNotNull())
        .groupBy("doc_id", "item_id", "n_item_tokens")
        .agg(F.max("matched").alias("n_matched"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    leaks = materialize(find_overlaps(docs, benchmark).select(F.col("doc_id").alias("__leak")).distinct())
    return docs.join(broadcast_if_small(leaks), F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti")


def op4_benchmark_decontamination(spark, sf_dir):
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS bs FROM benchmark),
i AS (SELECT bid, item_id, n, least(n, 13) AS width, CASE WHEN n >= 13 THEN 11 ELSE n END AS need, j, bs[j] AS tok
      FROM (SELECT *, len(bs) AS n, unnest(range(1, len(bs) + 1)) AS j FROM b WHERE len(bs) >= 7)),
t AS (SELECT rid, doc_id, p, ws[p] AS tok FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM d)),
m AS (SELECT rid, doc_id, bid, item_id, n, width, need, p - j AS diagonal, j FROM t JOIN i ON t.tok = i.tok),
c AS (SELECT *, row_number() OVER w AS k, lead(j, need - 1) OVER w AS far, count(*) OVER (PARTITION BY rid, bid, diagonal) AS matched
      FROM m WINDOW w AS (PARTITION BY rid, bid, diagonal ORDER BY j))
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_tokens, CAST(max(matched) AS BIGINT) AS n_matched
FROM c WHERE far - j < width GROUP BY doc_id, item_id, n
"""
