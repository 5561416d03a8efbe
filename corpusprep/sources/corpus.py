"""Reading and writing stories as JSON and as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.config import EOS, SPLITTER
from corpusprep.sources.jsonarray import read_json_array

STORY_SCHEMA = "source string, story string"


def read_story_json(spark: SparkSession, path: str) -> DataFrame:
    """``(story_id, source, text)`` of JSON files that each hold an array of objects.

    A record without a source is on no list; a record without a story is an error
    only once its source is accepted (``plans.corpus``). A broken file is an error.
    ``story_id`` is taken from the story's digest, so it does not hang on how files
    are dealt to tasks; records with one text share it. A large array is read by
    many tasks (``jsonarray``).
    """
    raw = read_json_array(spark, path, STORY_SCHEMA)
    digest = F.conv(F.substring(F.md5(F.col("story")), 1, 15), 16, 10).cast("bigint")
    return raw.select(digest.alias("story_id"), "source", F.col("story").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line_no, line)`` of text files, lines ending in LF, CR or CRLF.

    ``block`` is the offset of the input split. Line numbers rise inside a block
    and have gaps.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def read_records(spark: SparkSession, path: str, separator: str = SPLITTER) -> DataFrame:
    """One row per story of a text file with its own separator."""
    return spark.read.text(path, lineSep=separator).withColumnRenamed("value", "text")


def write_records(records: DataFrame, path: str, separator: str = SPLITTER) -> None:
    """Replace ``path`` by story records, each followed by the separator."""
    records.select("text").write.mode("overwrite").text(path, lineSep=separator)


def write_delimited(stories: DataFrame, path: str, eos: str = EOS) -> None:
    """Replace ``path`` by stories, each closed by a line with the end marker."""
    closed = stories.select(F.concat("text", F.lit(f" \n{eos}")).alias("text"))
    closed.write.mode("overwrite").text(path, lineSep="\n")
