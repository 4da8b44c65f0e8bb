"""Shared pieces of the text operators: word splitting, checkpoints, size checks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.storage import shared_folder, written

#: Fixed by the result contracts: what separates words.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as an array; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK))


def let(value: Column, body) -> Column:
    """Bind `value` once for use inside lambdas, which would evaluate it again for each element."""
    return F.transform(F.array(value), body)[0]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, bound: int) -> bool:
    """Whether a table has no more than `bound` rows; reads no more than it must."""
    return df.limit(bound + 1).count() <= bound


def broadcast_if_small(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """A written table of keys and a few numbers, with the hint to broadcast it if it has at most `bound` rows."""
    return F.broadcast(df) if at_most(df, bound) else df


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared checkpoint folder; smaller on disk than a checkpoint of many rows."""
    return written(df)


def spark_broadcast(df: DataFrame, value):
    """A value of bounded size for the Python functions that run over a table."""
    return df.sparkSession.sparkContext.broadcast(value)


#: Rows and bytes of texts that a Python worker gets at a time.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(df: DataFrame) -> None:
    """Prepare the session for Python functions over texts.

    Arrow batches get no larger than what long texts allow (a session that asks for less keeps it),
    and workers find this package where the driver does, if they share its folder.
    """
    conf, env = df.sparkSession.conf, df.sparkSession.sparkContext.environment
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
