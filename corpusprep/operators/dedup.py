"""Accept-list filter, exact duplicate removal and the train/valid split."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.config import SPLITS

DRAW_DIGITS = 15  # hexadecimal digits of a draw: 60 bits


def accept_sources(stories: DataFrame, accepted, source: str = "source") -> DataFrame:
    """Rows whose source is on the list; matching is case-sensitive."""
    return stories.where(F.col(source).isin(*accepted))


def exact_dedup(stories: DataFrame, story_id: str = "story_id", text: str = "text") -> DataFrame:
    """One row per distinct text: the smallest id and the number of copies.

    The text is the grouping key, so copies collapse before the shuffle, a text
    that fills a third of the rows sends one row per task, and every text moves
    once at most.
    """
    return stories.groupBy(text).agg(
        F.min(story_id).alias(story_id), F.count(F.lit(1)).alias("copies")
    )


def duplicate_count(stories: DataFrame, text: str = "text") -> DataFrame:
    """Rows minus distinct texts, counted on 32-byte digests of the texts."""
    copies = (
        stories.select(F.unhex(F.sha2(text, 256)).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def split_of(text: Column, train_ratio: float, seed: int = 0) -> Column:
    """``train`` or ``valid``, drawn from a hash of seed and text.

    The draw depends on nothing but its input, so retries and other
    partitionings give the same split.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), text))
    draw = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint")
    train, valid = SPLITS
    held_out = draw >= F.lit(split_bound(train_ratio))
    return F.when(held_out, valid).otherwise(train)


def split_bound(train_ratio: float) -> int:
    """The smallest draw that is held out; exact for any ratio."""
    return int(Fraction(train_ratio) * 16**DRAW_DIGITS)


def split_stats(stories: DataFrame) -> DataFrame:
    """Stories and share per split; the share is taken over two rows."""
    counts = stories.groupBy("split").agg(F.count(F.lit(1)).alias("stories"))
    total = F.sum("stories").over(Window.partitionBy())
    return counts.select("split", "stories", F.round(F.col("stories") / total, 6).alias("share"))

