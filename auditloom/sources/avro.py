"""Names in an Avro schema document: records with their fields, enums with their symbols."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

from auditloom.sources.windows import read_json

#: Keys under which a schema holds further schemas.
_NESTED = ("type", "items", "values", "fields")


def named_types(schema) -> list[tuple[str, str, list[str]]]:
    """(kind, name, fields or symbols) of each named record and enum, by kind and name; a name counts once."""
    found: dict[tuple[str, str], list[str]] = {}
    todo = deque([schema])
    while todo:
        part = todo.popleft()
        if isinstance(part, list):
            todo.extend(part)
        elif isinstance(part, dict):
            kind, name = part.get("type"), part.get("name")
            if name and kind == "enum":
                found.setdefault((kind, name), list(part.get("symbols", [])))
            elif name and kind == "record":
                found.setdefault((kind, name), [f.get("name") for f in part.get("fields", [])])
            todo.extend(part[k] for k in _NESTED if isinstance(part.get(k), (dict, list)))
    return [(kind, name, members) for (kind, name), members in sorted(found.items())]


def schema_table(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, members of a schema file."""
    return spark.createDataFrame(named_types(read_json(spark, path)), "kind string, name string, members array<string>")
