"""Raw record lines made from the driver's tables, so that the parsers have whole tables to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources import tables
from auditloom.sources.schemas import RECORD_PREFIX


def _wrapped(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.create_map(F.lit(kind), value))


def _line(kind: str, payload: Column, host: Column) -> Column:
    return F.to_json(F.struct(
        F.create_map(F.lit(RECORD_PREFIX + kind), payload).alias("datum"), host.alias("hostId"), F.lit("table").alias("source"), F.lit(1).alias("sessionNumber")
    ))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, file."""
    c, uuid = F.col, RECORD_PREFIX + "UUID"
    ev, su, fi, ne = tables.events(spark, sf_dir), *[f(spark, sf_dir) for f in (tables.subjects, tables.fileobjects, tables.netflows)]
    none = F.lit(None).cast("string")
    n = F.substring("uuid", 2, 9).cast("long")
    parts = [
        ev.select(_line("Event", F.struct(
            "uuid", c("event_type").alias("type"), c("timestampNanos"), _wrapped(uuid, c("subject_uuid")).alias("subject"), _wrapped(uuid, c("object1_uuid")).alias("predicateObject"),
            _wrapped(uuid, c("object2_uuid")).alias("predicateObject2"), _wrapped("long", c("size")).alias("size")), c("hostId")).alias("value"), F.concat("hostId", F.lit(".json")).alias("file")),
        su.select(_line("Subject", F.struct(
            "uuid", c("subject_type").alias("type"), "cid", _wrapped(uuid, c("parentSubject")).alias("parentSubject"), _wrapped("string", c("localPrincipal")).alias("localPrincipal"),
            _wrapped("long", c("startTimestampNanos")).alias("startTimestampNanos"), _wrapped("string", c("cmdLine")).alias("cmdLine")), none).alias("value"), F.lit("nodes.json").alias("file")),
        fi.select(_line("FileObject", F.struct("uuid", c("file_type").alias("type"), _wrapped("long", n).alias("size")), none).alias("value"), F.lit("nodes.json").alias("file")),
        ne.select(_line("NetFlowObject", F.struct(
            "uuid", _wrapped("string", c("localAddress")).alias("localAddress"), _wrapped("int", c("localPort")).alias("localPort"), _wrapped("string", c("remoteAddress")).alias("remoteAddress"),
            _wrapped("int", c("remotePort")).alias("remotePort"), _wrapped("int", c("ipProtocol")).alias("ipProtocol")), none).alias("value"), F.lit("nodes.json").alias("file")),
        ne.select(_line("RegistryKeyObject", F.struct("uuid", F.concat(F.lit("key "), c("uuid")).alias("key")), none).alias("value"), F.lit("nodes.json").alias("file")),
        ne.select(_line("IpcObject", F.struct("uuid", F.lit("PIPE").alias("type"), _wrapped("int", n).alias("fd1"), _wrapped("int", n + 1).alias("fd2")), none).alias("value"), F.lit("nodes.json").alias("file")),
        ne.select(_line("MemoryObject", F.struct("uuid", (4096 * n).alias("memoryAddress"), _wrapped("long", F.lit(64)).alias("size")), none).alias("value"), F.lit("nodes.json").alias("file")),
        spark.range(1).select(_line("Host", F.struct(F.lit("h").alias("uuid")), none).alias("value"), F.lit("nodes.json").alias("file")),
        spark.range(1).select(F.lit("not json").alias("value"), F.lit("nodes.json").alias("file")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
