"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A folder of this machine is used only when the session sets none and runs
    in local mode; a cluster has to name one that all executors see.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return own_folder(spark.sparkContext.applicationId)


@cache
def own_folder(application: str) -> str:
    """One folder per local application; the session's own settings stay as they are."""
    return tempfile.mkdtemp(prefix="corpusprep-")


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` as a Parquet table of its own and return its path."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` at a written table; columns stay prunable."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``write_scratch`` once nothing reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
