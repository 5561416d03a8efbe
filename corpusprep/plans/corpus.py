"""From raw stories to the story table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.config import EOS, CorpusConfig
from corpusprep.functions.text import clean_lines, story_record, strip
from corpusprep.operators.dedup import accept_sources, exact_dedup, split_of
from corpusprep.operators.index import first_stories


def select_stories(raw: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """``(story_id, split, text)``: accepted, stripped, distinct stories.

    The order matters: only accepted rows count as duplicates, and stories are
    compared after stripping. Sources are filtered in the scan.
    """
    accepted = accept_sources(raw, cfg.accepted_sources)
    missing = F.raise_error(F.lit("accepted record without a story")).cast("string")
    return distinct_stories(accepted.withColumn("text", F.coalesce("text", missing)), cfg)


def distinct_stories(raw: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """``select_stories`` for rows that are all accepted."""
    stripped = raw.select("story_id", strip(F.col("text")).alias("text"))
    return exact_dedup(stripped).select(
        "story_id", split_of(F.col("text"), cfg.train_ratio, cfg.seed).alias("split"), "text"
    )


def story_records(stories: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """Stories as cleaned lines closed by the end marker, capped per split.

    A line equal to the marker ends a story; what follows it is a story of its own,
    whose id is taken from a digest of the first one's id and the part.
    """
    others = [F.col(c) for c in stories.columns if c not in ("story_id", "text")]
    # Not a column first: Spark would filter on it below, and so clean every text twice.
    parts = F.posexplode(marked_parts(F.col("text"), cfg.keep_empty)).alias("_no", "_lines")
    cut = stories.select("story_id", *others, parts)
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "story_id", "_no")), 1, 15), 16, 10).cast("bigint")
    story_id = F.when(F.col("_no") == 0, F.col("story_id")).otherwise(digest)
    records = cut.select(story_id.alias("story_id"), *others, story_record(F.col("_lines")).alias("text"))
    return first_stories(records.select(*stories.columns), cfg.max_stories)


def marked_parts(text: Column, keep_empty: bool, eos: str = EOS) -> Column:
    """The cleaned lines between marker lines, as an array of arrays; empty parts may go.

    Only a text that holds the marker is cut. Its lines are computed once: the lambda
    over an array of one element gives them a name.
    """
    cut = F.get(F.transform(F.array(clean_lines(text)), lambda lines: parts_between(lines, eos)), 0)
    parts = F.when(text.contains(eos), cut).otherwise(F.array(clean_lines(text)))
    return parts if keep_empty else F.filter(parts, lambda p: F.size(p) > 0)


def parts_between(lines: Column, eos: str) -> Column:
    bounds = F.filter(F.transform(lines, lambda x, i: F.when(x == eos, i + 1)), lambda i: i.isNotNull())
    ends = F.concat(bounds, F.array(F.size(lines) + 1))
    starts = F.concat(F.array(F.lit(0)), bounds)
    return F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a - 1))
