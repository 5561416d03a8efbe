"""Parquet tables of the pipeline, one directory per table with split folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a file scan that has fewer splits than there are cores.

    Large inputs have more splits and pass through without a shuffle. Only for
    scans: asking for the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace the table at ``path``; each split becomes one folder."""
    out = df if partitions is None else df.repartition(partitions)
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def write_blocks(blocks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace the block table; files hold ranges of ids in order, so lookups skip row groups."""
    keys = ["split", "block_id"]
    out = blocks.repartitionByRange(*([partitions] if partitions else []), *keys)
    out.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table; other splits' files are not opened."""
    return spark.read.parquet(path).where(F.col("split") == split)
