"""Tables in and out: Parquet scans and writers, and the driver's tables as events and nodes."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.scalars import file_stem


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, recursive: bool = True, name_prefix: str | None = None, skip_corrupt: bool = False) -> DataFrame:
    """Parquet files of a folder; wanted columns that don't exist are left out; `name_prefix` selects files by name, whatever the case."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    df = reader.parquet(path)
    if name_prefix:
        df = df.where(F.lower(F.col("_metadata.file_name")).startswith(name_prefix.lower()))
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def scan_required(spark: SparkSession, paths: list[str], required: list[str], drop: list[str] | None = None) -> tuple[DataFrame | None, list[tuple[str, list[str]]]]:
    """The tables at these paths that have all required columns, as one, less the columns to drop; and those passed over, with what they lack.

    Only the files' schemas are read here.
    """
    kept, passed = None, []
    for path in paths:
        df = spark.read.parquet(path)
        lacks = missing_columns(df, required)
        if lacks:
            passed.append((path, lacks))
            continue
        df = df.drop(*(drop or []))
        kept = df if kept is None else kept.unionByName(df, allowMissingColumns=True)
    return kept, passed


def inspect(df: DataFrame, n: int = 3) -> tuple[list[tuple[str, str]], DataFrame]:
    """Columns with their types, and any n rows."""
    return df.dtypes, df.limit(n)


def write_table(df: DataFrame, path: str, compression: str = "zstd", rows_per_file: int | None = None, by_file: str | None = None, mode: str = "errorifexists", block_bytes: int | None = None) -> None:
    """Parquet; `by_file` names a column of file names, whose stems become folders; `block_bytes` bounds the row groups."""
    out = df if by_file is None else df.withColumn("file_stem", file_stem(F.col(by_file)))
    writer = out.write.mode(mode).option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    if by_file:
        writer = writer.partitionBy("file_stem")
    writer.parquet(path)


def write_relabelled(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Leaves what is there alone unless `overwrite`."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def relabel_files(spark: SparkSession, inputs: dict[str, str], label, required: list[str], overwrite: bool = False) -> list[tuple[str, str]]:
    """Relabels each input path to its output path: (input, what was done) of each.

    label: from a table to the labelled one. Outputs that are there stay unless `overwrite`; inputs
    without a required column are passed over.
    """
    done = []
    for source, target in inputs.items():
        df = spark.read.parquet(source)
        lacks = missing_columns(df, required)
        there = spark._jvm.org.apache.hadoop.fs.Path(target)
        if lacks:
            done.append((source, "lacks " + " ".join(lacks)))
        elif not overwrite and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            done.append((source, "there"))
        else:
            write_relabelled(label(df), target, overwrite)
            done.append((source, "written"))
    return done


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with a header; for tables of windows and graphs."""
    df.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A summary row as JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_graphs(nodes: DataFrame, edges: DataFrame, windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Node and edge tables by label, in place of one file for each graph."""
    labels = windows.select("window_id", "label")
    for name, df in (("graph_node", nodes), ("graph_edge", edges)):
        df.drop("label").join(labels, "window_id").write.mode(mode).partitionBy("label").parquet(f"{path}/{name}")


def write_multigraph(edges: DataFrame, nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Edges by window, and one table of vertices with their attributes."""
    edges.write.mode(mode).partitionBy("window_start_ns").parquet(f"{path}/edge")
    nodes.write.mode(mode).parquet(f"{path}/vertex")


#: The driver's tables have no host records: its `events` table stands for them, with ids made of its
# keys. Every kind of edge and node occurs.

def events(spark: SparkSession, sf_dir: str, between: tuple[int, int] | None = None) -> DataFrame:
    """Events of the model from the driver's table; ids start with s, f or n by the kind of node.

    between: least and greatest time in nanoseconds; as a filter on the stored column the scan skips by it.
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    user = F.col("user_id")
    file_id, flow_id = F.concat(F.lit("f"), k.cast("string")), F.concat(F.lit("n"), F.pmod(k, F.lit(20)).cast("string"))
    me = F.concat(F.lit("s"), user.cast("string"))
    backward = F.pmod(user, F.lit(30))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if between is not None:
        edges = [F.lit(datetime.fromtimestamp(0, timezone.utc).replace(tzinfo=None) + timedelta(microseconds=x)) for x in (between[0] // 1000, -(-between[1] // 1000))]
        raw = raw.where(F.col("ts").between(*[e.cast(raw.schema["ts"].dataType) for e in edges]))
    return raw.select(
        F.col("event_id").cast("string").alias("uuid"), "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestampNanos"),
        F.when(backward == 7, file_id).when(backward == 8, flow_id).otherwise(me).alias("subject_uuid"),
        F.when(F.pmod(k, F.lit(4)) == 0, flow_id).otherwise(file_id).alias("object1_uuid"),
        F.when(backward.isin(7, 8), me).when(F.pmod(k, F.lit(10)) == 3, F.concat(F.lit("s"), F.pmod(user + k, F.lit(150)).cast("string"))).alias("object2_uuid"),
        F.floor("value").alias("size"), F.concat(F.lit("h"), F.pmod(user, F.lit(4)).cast("string")).alias("hostId"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("first_ns"))
    return users.select(
        F.concat(F.lit("s"), u.cast("string")).alias("uuid"), F.lit("PROCESS").alias("subject_type"), u.alias("cid"),
        F.when(u % 3 != 0, F.concat(F.lit("s"), (u - 1).cast("string"))).alias("parentSubject"), F.concat(F.lit("user"), (u % 5).cast("string")).alias("localPrincipal"),
        F.when(u % 7 != 0, F.col("first_ns")).alias("startTimestampNanos"), F.when(u % 11 != 0, F.concat(F.lit("/usr/bin/tool"), (u % 13).cast("string"), F.lit(" --id "), u.cast("string"))).alias("cmdLine"),
    )


def fileobjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("k")).where("k IS NOT NULL").distinct()
    kind = F.element_at(F.array(*[F.lit(x) for x in ("FILE_OBJECT_BLOCK", "FILE_OBJECT_DIR", "FILE_OBJECT_LINK", None)]), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    return keys.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("uuid"), kind.alias("file_type"))


def netflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return spark.range(20).select(
        F.concat(F.lit("n"), i.cast("string")).alias("uuid"), F.concat(F.lit("10.0.0."), i.cast("string")).alias("localAddress"), (1024 + i).cast("int").alias("localPort"),
        F.when(i % 5 == 4, F.concat(F.lit("host"), i.cast("string"), F.lit(".example"))).when(i % 5 != 3, F.concat(F.lit("192.168.1."), i.cast("string"))).alias("remoteAddress"),
        F.when(i % 4 != 0, 443).cast("int").alias("remotePort"), F.lit(6).alias("ipProtocol"),
    )
