"""Tables written once to the shared checkpoint folder, so that several uses don't compute them again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none (tests) gets one of its own; a cluster must name one."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows, read from a Parquet table that holds them; the owner of the folder clears it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
