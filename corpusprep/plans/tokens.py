"""From the story table to packed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.config import SPLITS, CorpusConfig, PackConfig, PrepConfig, TokenizerConfig
from corpusprep.operators.batches import batch_plan, epoch_positions, epochs_for, step_plan
from corpusprep.operators.bpe import Tokenizer, train, word_counts
from corpusprep.operators.encode import (
    chunk_features,
    chunk_symbols,
    chunk_tokens,
    encode,
    encode_symbols,
)
from corpusprep.operators.index import first_stories
from corpusprep.operators.pack import block_ids, pack_blocks
from corpusprep.operators.segment import segment_stories
from corpusprep.plans.corpus import select_stories, story_records
from corpusprep.sources.corpus import read_lines
from corpusprep.sources.tables import read_table, spread, write_blocks, write_splits
from corpusprep.sources.tokenizer import save_tokenizer


def train_tokenizer(stories: DataFrame, cfg: TokenizerConfig) -> Tokenizer:
    """Learn the vocabulary on the train split only.

    The end marker is counted as ordinary text unless ``exclude_eos`` is set.
    """
    texts = stories.where(F.col("split") == "train").select("text")
    if cfg.exclude_eos:
        texts = texts.select(F.replace("text", F.lit(cfg.eos_token), F.lit("")).alias("text"))
    return train(word_counts(texts), cfg.vocab_size, cfg.eos_token)


def tokenized_chunks(
    stories: DataFrame, tokenizer: Tokenizer, context_length: int, as_symbols: bool = False
) -> DataFrame:
    """Stories as token chunks with their features; one pass, no shuffle.

    ``as_symbols`` gives the tokens in ``symbols``, as packing moves them.
    """
    if as_symbols:
        return chunk_features(chunk_symbols(encode_symbols(stories, tokenizer), context_length))
    return chunk_features(chunk_tokens(encode(stories, tokenizer), context_length))


def packed_blocks(chunks: DataFrame, cfg: PackConfig) -> DataFrame:
    """Blocks of every split, packed separately in one job."""
    return pack_blocks(chunks, cfg, by=("split",))


def prepare(raw: DataFrame, root: str, cfg: PrepConfig) -> None:
    """Run all stages on ``(story_id, source, text)`` rows.

    Each stage writes its table under ``root`` and the next one reads it, so a
    failed run goes on from files, and the table a stage scans twice is not
    computed twice.
    """
    spark = raw.sparkSession
    write_splits(story_records(select_stories(raw, cfg.corpus), cfg.corpus), f"{root}/stories")
    prepare_stories(spark, root, cfg)


def prepare_text(spark: SparkSession, files: dict[str, str], root: str, cfg: PrepConfig) -> None:
    """Run all stages on delimited text files, ``files`` naming those of each split.

    The given split is kept. Stories are numbered in the order of splits, files and
    places in a file, whatever tasks read them.
    """
    write_splits(text_stories(spark, files, cfg.corpus), f"{root}/stories")
    prepare_stories(spark, root, cfg)


def text_stories(spark: SparkSession, files: dict[str, str], cfg: CorpusConfig) -> DataFrame:
    """``(split, story_id, text)`` of delimited text files, capped per split."""
    lines = None
    for split, path in files.items():
        own = read_lines(spark, path).withColumn("split", F.lit(split))
        lines = own if lines is None else lines.unionByName(own)
    stories = segment_stories(lines, keep_empty=cfg.keep_empty, by=("split", "file"))
    return first_stories(number_stories(stories), cfg.max_stories)


def number_stories(stories: DataFrame) -> DataFrame:
    """``story_id`` from ``(split, file, story_no)``: stories of earlier files first."""
    of_file = ["split", "file"]
    counts = stories.groupBy(*of_file).agg((F.max("story_no") + 1).alias("n"))
    # One row per file; the split decides the high bits, so splits never share an id.
    earlier = Window.partitionBy("split").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*of_file, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    high = F.array_position(F.lit(sorted(SPLITS)), F.col("split")).cast("bigint")
    story_id = F.shiftleft(high, 56) + F.col("base") + F.col("story_no")
    return stories.join(bases, of_file).select("split", story_id.alias("story_id"), "text")


def prepare_stories(spark: SparkSession, root: str, cfg: PrepConfig) -> None:
    """From the written story table to packed blocks."""
    stories = spread(read_table(spark, f"{root}/stories"))
    tokenizer = train_tokenizer(stories, cfg.tokenizer)
    save_tokenizer(spark, tokenizer, f"{root}/tokenizer")
    chunks = tokenized_chunks(stories, tokenizer, cfg.pack.context_length)
    write_splits(chunks, f"{root}/chunks")
    blocks = packed_blocks(read_table(spark, f"{root}/chunks"), cfg.pack)
    write_blocks(blocks, f"{root}/blocks", cfg.pack.partitions)


def training_plan(chunks: DataFrame, cfg: PrepConfig) -> DataFrame:
    """``(epoch, block_id, batch_no, pos, optimizer_step)`` of the train split up to ``max_steps``.

    The driver learns the number of blocks, from which the epochs follow.
    """
    ids = block_ids(chunks.where(F.col("split") == "train").drop("split"), cfg.pack)
    epochs = epochs_for(ids.count(), cfg.training)
    plan = batch_plan(epoch_positions(ids, epochs, cfg.pack.seed), cfg.training)
    return step_plan(plan, cfg.training)


def validation_plan(chunks: DataFrame, cfg: PrepConfig) -> DataFrame:
    """``(epoch, block_id, batch_no, pos)`` of the valid split, in order."""
    ids = block_ids(chunks.where(F.col("split") == "valid").drop("split"), cfg.pack)
    return batch_plan(epoch_positions(ids, 1, shuffle=False), cfg.training)
