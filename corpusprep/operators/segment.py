"""Cutting files of lines into stories, however the files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.config import EOS
from corpusprep.functions.text import story_record, strip
from corpusprep.operators.index import running_total


def segment_stories(
    lines: DataFrame, eos: str = EOS, keep_empty: bool = True, by: tuple[str, ...] = ("file",)
) -> DataFrame:
    """Stories of a table of lines ``(*by, block, line_no, line)``.

    A stripped line equal to ``eos`` ends a story; blank lines go; lines after
    the last end marker of a file belong to no story. ``line_no`` orders lines
    inside a block and ``block`` orders the blocks of a file.
    """
    marked = lines.withColumn("line", strip(F.col("line"))).where(F.col("line") != "")
    numbered = running_total(
        marked,
        (F.col("line") == eos).cast("int"),
        "story_no",
        F.col("block"),
        ["line_no"],
        by,
        total="_stories",
    )
    # The tail leaves before stories are collected, so its size does not matter.
    kept = numbered.where(F.col("story_no") < F.col("_stories"))
    content = F.when(F.col("line") != eos, F.struct("block", "line_no", "line"))
    stories = kept.groupBy(*by, "story_no").agg(
        F.transform(F.array_sort(F.collect_list(content)), lambda x: x["line"]).alias("_lines")
    )
    if not keep_empty:
        stories = stories.where(F.size("_lines") > 0)
    return stories.select(*by, "story_no", story_record(F.col("_lines"), eos).alias("text"))
