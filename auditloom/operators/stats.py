"""Statistics and checks over the tables of a graph corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.graphs import RELATIONS

NODE_TYPES = ("subject", "fileobject", "netflow")


def graph_stats(windows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each window that has nodes: label, bounds, nodes by type, edges by relation, totals."""
    n = nodes.groupBy("window_id").agg(*[F.count_if(F.col("node_type") == t).alias(f"n_{t}") for t in NODE_TYPES])
    names = ["_".join(r) for r in RELATIONS]
    e = edges.groupBy("window_id").agg(*[F.count_if(F.col("relation") == "->".join(r)).alias(f"E_{name}") for r, name in zip(RELATIONS, names)])
    out = windows.join(n, "window_id").join(e, "window_id", "left").na.fill(0, [f"E_{name}" for name in names])
    total = lambda cols: reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return out.select(
        "window_id", F.col("label").alias("graph_label"), "start_ns", "end_ns", total([f"n_{t}" for t in NODE_TYPES]).alias("total_nodes"),
        total([f"E_{name}" for name in names]).alias("total_edges"), *[f"n_{t}" for t in NODE_TYPES], *[f"E_{name}" for name in names],
    )


def corpus_summary(stats: DataFrame) -> DataFrame:
    """One row of totals and means; windows without nodes count in no mean of ratios."""
    names = [f"n_{t}" for t in NODE_TYPES] + ["E_" + "_".join(r) for r in RELATIONS]
    ratio = F.when(F.col("total_nodes") != 0, F.col("total_edges") / F.col("total_nodes"))
    return stats.agg(
        F.count(F.lit(1)).alias("num_graphs"), F.count_if(F.col("graph_label") == 1).alias("num_malicious"), F.count_if(F.col("graph_label") == 0).alias("num_benign"),
        F.sum("total_nodes").alias("total_nodes_sum"), F.sum("total_edges").alias("total_edges_sum"), F.avg("total_nodes").alias("avg_nodes_per_graph"),
        F.avg("total_edges").alias("avg_edges_per_graph"), F.avg(ratio).alias("avg_degree_overall"), *[F.sum(c).alias(f"sum_{c}") for c in names],
    )


def edge_type_freq(edges: DataFrame, k: int = 30) -> DataFrame:
    return edges.groupBy("edge_type_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "edge_type_id").limit(k)


def array_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def class_weights(windows: DataFrame, label: str = "graph_label") -> DataFrame:
    counts = windows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", 1.0 / (F.col("n") + 1e-6))


def dataset_stats(stats: DataFrame) -> DataFrame:
    parts = [array_stats(stats, c).select(F.lit(c).alias("measure"), "*") for c in ("total_nodes", "total_edges")]
    return parts[0].unionByName(parts[1])


def feature_spread(features: DataFrame, column: str = "x") -> DataFrame:
    """Least and largest feature, and the means over graphs of each graph's mean and sample deviation."""
    own = features.select("window_id", F.explode(column).alias("v"))
    graph = own.groupBy("window_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return graph.agg(F.min("lo").alias("min"), F.max("hi").alias("max"), F.avg("m").alias("mean_of_means"), F.avg("s").alias("mean_of_stds"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lo, n of equal bins between least and largest value (one row of two numbers on the driver); the last bin holds the largest."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, n bigint")
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    place = F.least(F.floor((F.col(column) - F.lit(lo)) * bins / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))


def key_consistency(keys: DataFrame) -> DataFrame:
    """key, n_missing, examples (first three by name) of the files that lack it. keys: file, keys (array).

    The distinct keys are a file format's, so few; each file lists the ones it lacks by itself.
    """
    every = sorted(r[0] for r in keys.select(F.explode("keys").alias("key")).distinct().collect())
    own = keys.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    gaps = own.select("file", F.explode(F.array_except(F.array(*map(F.lit, every)).cast("array<string>"), "keys")).alias("key"))
    counted = gaps.withColumn("__k", F.row_number().over(Window.partitionBy("key").orderBy("file"))).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_missing"), F.array_sort(F.collect_list(F.when(F.col("__k") <= 3, F.col("file")))).alias("examples")
    )
    named = keys.sparkSession.createDataFrame([(k,) for k in every], "key string")
    return named.join(counted, "key", "left").select(
        "key", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples")
    )


def feature_widths(parts: dict[str, DataFrame], expected: dict[str, int], columns: dict[str, str]) -> DataFrame:
    """feature_set, widths (sorted distinct sizes), consistent, as_expected."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.array_sort(F.collect_set(F.size(columns.get(name, "x")))).alias("widths")).select(
            F.lit(name).alias("feature_set"), "widths", (F.size("widths") <= 1).alias("consistent"), (F.col("widths") == F.array(F.lit(expected[name]))).alias("as_expected")
        )
        out = row if out is None else out.unionByName(row)
    return out


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, n_rows, n_null of every column."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)])
        rows = F.array(*[
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{k}")).alias("n_null"))
            for k, (c, kind) in enumerate(df.dtypes)
        ])
        part = counts.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def split_assign(df: DataFrame, source: Column) -> DataFrame:
    """split train, val or test, 70/15/15 by a hash of the source, so that a source is never in two splits."""
    place = F.conv(F.substring(F.md5(source.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(place < 70, "train").when(place < 85, "val").otherwise("test"))
