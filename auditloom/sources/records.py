"""Raw record lines (NDJSON, plain or gzip) to typed event and node tables.

Malformed lines count as lines and give no record. Values that a union wraps in a one-key object
are unwrapped everywhere, so that all columns are scalars. Text that is no number gives null in a
numeric column; an event without any usable time gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.schemas import RECORD_PREFIX, RECORD_TABLES, TIME_KEYS


def read_lines(spark: SparkSession, paths: str | list[str], braces_only: bool = False) -> DataFrame:
    """value, file of every line that isn't blank; `braces_only` keeps lines that start with `{`."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.where(F.col("value").startswith("{") if braces_only else F.trim("value") != "")


def unwrap(raw: Column) -> Column:
    """The only value of a one-key object, any other value as it is; raw is JSON text or a scalar."""

    def inner(text: Column) -> Column:
        fields = F.from_json(text, "map<string,string>")
        return F.transform(F.array(fields), lambda m: F.when(F.size(m) == 1, F.map_values(m)[0]).otherwise(text))[0]

    return F.when(F.substring(F.ltrim(raw), 1, 1) == "{", inner(raw)).otherwise(raw)


def number(text: Column, kind: str = "bigint") -> Column:
    """Whole number of a text; digits first, so that nothing goes through a double, then fractions cut off."""
    return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))


def records(lines: DataFrame) -> DataFrame:
    """lines with: parsed (whether it is JSON), table (null for other types), payload and values (maps; values are unwrapped), hostId, source, sessionNumber."""
    top = F.from_json("value", "datum map<string,string>, hostId string, source string, sessionNumber string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = lines.withColumn("__top", top).withColumn("parsed", F.expr("try_parse_json(value)").isNotNull())
    table, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in reversed(RECORD_TABLES.items()):
        key = F.lit(RECORD_PREFIX + kind)
        has = F.coalesce(F.map_contains_key(F.col("__top.datum"), key), F.lit(False))
        table = F.when(has, F.lit(name)).otherwise(table)
        payload = F.when(has, F.try_element_at(F.col("__top.datum"), key)).otherwise(payload)
    maps = F.transform(
        F.array(F.from_json(payload, "map<string,string>")), lambda m: F.struct(m.alias("payload"), F.transform_values(m, lambda _, v: unwrap(v)).alias("values"))
    )[0]
    # The generator is a barrier: filters on parsed values don't move below it and parse the line again for each use.
    fields = F.struct(
        "parsed", table.alias("table"), maps.alias("m"), F.col("__top.hostId").alias("hostId"), F.col("__top.source").alias("source"),
        number(F.col("__top.sessionNumber")).alias("sessionNumber"),
    )
    out = out.select(*lines.columns, F.inline(F.array(fields)))
    return out.select(*lines.columns, "parsed", "table", "m.payload", "m.values", "hostId", "source", "sessionNumber")


def _get(key: str) -> Column:
    return F.try_element_at(F.col("values"), F.lit(key))


def _plain(key: str) -> Column:
    return F.try_element_at(F.col("payload"), F.lit(key))


_ENVELOPE = ("hostId", "source", "sessionNumber")


def parse_events(parsed: DataFrame) -> DataFrame:
    time = F.coalesce(*[number(_get(k)) for k in TIME_KEYS])
    return (
        parsed.where(F.col("table") == "events")
        .select(
            _plain("uuid").alias("uuid"), _plain("type").alias("event_type"), time.alias("timestampNanos"), _get("subject").alias("subject_uuid"),
            _get("predicateObject").alias("object1_uuid"), _get("predicateObject2").alias("object2_uuid"), number(_get("size")).alias("size"), *_ENVELOPE,
        )
        .where(F.col("timestampNanos").isNotNull())
    )


def parse_subjects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("table") == "subjects").select(
        _plain("uuid").alias("uuid"), _plain("type").alias("subject_type"), number(_get("cid")).alias("cid"), _get("parentSubject").alias("parentSubject"),
        _get("localPrincipal").alias("localPrincipal"), number(_get("startTimestampNanos")).alias("startTimestampNanos"), _get("cmdLine").alias("cmdLine"),
        _get("privilegeLevel").alias("privilegeLevel"), *_ENVELOPE,
    )


def parse_fileobjects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("table") == "fileobjects").select(
        _plain("uuid").alias("uuid"), _plain("type").alias("file_type"), _get("fileDescriptor").alias("fileDescriptor"), number(_get("size")).alias("size"), *_ENVELOPE
    )


def parse_netflows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("table") == "netflows").select(
        _plain("uuid").alias("uuid"), unwrap(_get("localAddress")).alias("localAddress"), number(unwrap(_get("localPort")), "int").alias("localPort"),
        unwrap(_get("remoteAddress")).alias("remoteAddress"), number(unwrap(_get("remotePort")), "int").alias("remotePort"),
        number(unwrap(_get("ipProtocol")), "int").alias("ipProtocol"), _get("fileDescriptor").alias("fileDescriptor"), *_ENVELOPE,
    )


def parse_registry(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("table") == "registrykeys").select(_plain("uuid").alias("uuid"), _get("key").alias("key"), *_ENVELOPE)


def parse_ipc(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("table") == "ipc").select(
        _plain("uuid").alias("uuid"), _plain("type").alias("ipc_type"), number(_get("fd1")).alias("fd1"), number(_get("fd2")).alias("fd2"), *_ENVELOPE
    )


def parse_memory(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("table") == "memory").select(
        _plain("uuid").alias("uuid"), number(_get("memoryAddress")).alias("memoryAddress"), number(_get("size")).alias("size"), *_ENVELOPE
    )


PARSERS = {
    "events": parse_events, "subjects": parse_subjects, "fileobjects": parse_fileobjects, "netflows": parse_netflows,
    "registrykeys": parse_registry, "ipc": parse_ipc, "memory": parse_memory,
}


def record_type_counts(parsed: DataFrame) -> DataFrame:
    """Rows by table; `other` for JSON of other types, `malformed` for lines that aren't JSON."""
    kind = F.when(~F.col("parsed"), "malformed").otherwise(F.coalesce("table", F.lit("other")))
    return parsed.groupBy(kind.alias("record_type")).agg(F.count(F.lit(1)).alias("n"))


def ingest_counts(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """file, n_lines, n_events, n_malicious, and a row with file null for all. labelled: events with file and malicious."""
    by_file = lines.select("file", F.lit(1).alias("l"), F.lit(0).alias("e"), F.lit(0).alias("m")).unionByName(
        labelled.select("file", F.lit(0).alias("l"), F.lit(1).alias("e"), F.col("malicious").cast("int").alias("m"))
    )
    return by_file.rollup("file").agg(
        F.sum("l").cast("long").alias("n_lines"), F.sum("e").cast("long").alias("n_events"), F.sum("m").cast("long").alias("n_malicious")
    )
