"""Registered queries: every operator of the library over the whole test tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.config import (
    EOS,
    CorpusConfig,
    PackConfig,
    PrepConfig,
    TokenizerConfig,
    TrainingConfig,
)
from corpusprep.functions.bytelevel import SYMBOL_BASE, byte_symbols
from corpusprep.functions.normalize import nfkc
from corpusprep.functions.pretokenize import words
from corpusprep.functions.text import (
    clean_lines,
    delimited_story,
    parse_int_list,
    story_record,
    strip,
)
from corpusprep.operators import batches, bpe, dedup, encode, index, pack, segment
from corpusprep.operators.bpe import Tokenizer
from corpusprep.plans import corpus, tokens
from corpusprep.sources.scratch import materialize
from corpusprep.sources.tables import spread
from spark_oracles import ORACLES, Q

# The queries of the llm folder, if it is there.
try:
    from corpusprep.llm.registry import ORACLES as LLM_ORACLES
    from corpusprep.llm.registry import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    if missing.name not in ("corpusprep.llm", "corpusprep.llm.registry", "corpus_pipeline"):
        raise
    LLM_ORACLES, LLM_QUERIES = {}, {}

CORPUS = CorpusConfig(accepted_sources=Q.accepted, seed=Q.seed)
PACK = PackConfig(seed=Q.seed)
TRAINING = TrainingConfig(max_steps=Q.max_steps)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(table.select(F.col("doc_id").alias("story_id"), "source", "text"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_stories(raw(spark, sf_dir), CORPUS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.story_records(stories(spark, sf_dir), CORPUS)


def joined(ids: str):
    return F.array_join(ids, ",").alias(ids)


def byte_chunks(spark: SparkSession, sf_dir: str, as_symbols: bool = False) -> DataFrame:
    """Chunks under the vocabulary without merges, one token per byte."""
    rows = raw(spark, sf_dir).select("story_id", "text")
    return tokens.tokenized_chunks(rows, Tokenizer(), PACK.context_length, as_symbols)


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as a written table, since packing scans them several times."""
    chunks = byte_chunks(spark, sf_dir, as_symbols=True).select("story_id", "chunk_no", "length", "symbols")
    return pack.with_ids(spread(materialize(pack.as_symbols(chunks), "chunks")))


def byte_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_blocks(chunk_table(spark, sf_dir), PACK)


# Corpus selection


def accepted_source_filter(spark, sf_dir):
    return dedup.accept_sources(raw(spark, sf_dir), Q.accepted)


def story_strip(spark, sf_dir):
    return raw(spark, sf_dir).select("story_id", strip(F.col("text")).alias("text"))


def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(story_strip(spark, sf_dir))


def duplicate_count(spark, sf_dir):
    return dedup.duplicate_count(story_strip(spark, sf_dir))


def accepted_stories(spark, sf_dir):
    return corpus.select_stories(raw(spark, sf_dir), CORPUS)


def train_valid_split(spark, sf_dir):
    return stories(spark, sf_dir).select("story_id", "split")


def split_stats(spark, sf_dir):
    return dedup.split_stats(stories(spark, sf_dir))


def corpus_counts(spark, sf_dir):
    train = stories(spark, sf_dir).where(F.col("split") == "train")
    return train.agg(F.count(F.lit(1)).alias("train_stories"))


# Lines, records and order


def clean_lines_query(spark, sf_dir):
    lines = clean_lines(F.col("text"))
    return raw(spark, sf_dir).select("story_id", F.posexplode(lines).alias("line_no", "line"))


def story_records(spark, sf_dir):
    record = story_record(clean_lines(F.col("text")))
    return raw(spark, sf_dir).select("story_id", record.alias("text"))


def segment_stories(spark, sf_dir):
    """Each source is one file of delimited stories, cut into blocks of many lines."""
    lines = raw(spark, sf_dir).select(
        F.col("source").alias("file"),
        "story_id",
        F.posexplode(F.split(delimited_story(F.col("text")), "\n")).alias("at", "line"),
    )
    blocks = lines.select(
        "file",
        index.int_div(F.col("story_id"), Q.block_stories).alias("block"),
        F.struct("story_id", "at").alias("line_no"),
        "line",
    )
    return segment.segment_stories(blocks)


def story_index(spark, sf_dir):
    return index.row_index(raw(spark, sf_dir).select("story_id"), "story_id")


def feed_batches(spark, sf_dir):
    return index.feed_batches(raw(spark, sf_dir).select("story_id"), Q.feed_batch)


def story_cap(spark, sf_dir):
    capped = index.first_stories(stories(spark, sf_dir), Q.max_stories)
    return capped.select("story_id", "split")


# Words, vocabulary and token ids


def nfkc_query(spark, sf_dir):
    return raw(spark, sf_dir).select("story_id", nfkc(F.col("text")).alias("text"))


def pretokens(spark, sf_dir):
    found = words(nfkc(F.col("text")))
    return raw(spark, sf_dir).select("story_id", F.posexplode(found).alias("pos", "word"))


def train_texts(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).where(F.col("split") == "train").select("text")


def word_counts(spark, sf_dir):
    return bpe.word_counts(train_texts(spark, sf_dir))


def byte_symbols_query(spark, sf_dir):
    """Use of each byte token in the training texts."""
    letters = F.split(byte_symbols(F.col("word")), "")
    used = word_counts(spark, sf_dir).select("freq", F.explode(letters).alias("symbol"))
    token_id = (F.ascii("symbol") - SYMBOL_BASE).cast("bigint").alias("token_id")
    return used.groupBy(token_id).agg(F.sum("freq").alias("uses"))


def bpe_pair_counts(spark, sf_dir):
    return bpe.pair_counts(bpe.symbol_words(word_counts(spark, sf_dir)))


def trained(spark, sf_dir) -> Tokenizer:
    return bpe.train(word_counts(spark, sf_dir), Q.vocab_size)


def bpe_merges(spark, sf_dir):
    return bpe.merges_table(spark, trained(spark, sf_dir))


def vocab(spark, sf_dir):
    table = bpe.vocab_table(spark, trained(spark, sf_dir))
    return table.select("token_id", F.hex("token").alias("token"), "special")


def encode_stories(spark, sf_dir):
    rows = encode.encode(records(spark, sf_dir), trained(spark, sf_dir))
    return rows.select("story_id", "split", joined("input_ids"))


def token_use(spark, sf_dir):
    tokenizer = trained(spark, sf_dir)
    rows = encode.encode(records(spark, sf_dir), tokenizer)
    return encode.token_use(rows, tokenizer).select("token_id", "uses")


def decode_roundtrip(spark, sf_dir):
    tokenizer = trained(spark, sf_dir)
    rows = encode.encode(records(spark, sf_dir).select("story_id", "text"), tokenizer)
    return encode.decode(rows, tokenizer, skip_special=False)


def chunk_tokens(spark, sf_dir):
    rows = byte_chunks(spark, sf_dir)
    return rows.select("story_id", "chunk_no", joined("input_ids"))


def chunk_features(spark, sf_dir):
    return byte_chunks(spark, sf_dir).select(
        "story_id",
        "chunk_no",
        joined("token_type_ids"),
        joined("attention_mask"),
        "length",
        "overflow_to_sample_mapping",
    )


def feature_rows(spark, sf_dir):
    """Features exploded to one row per token, summed up per story."""
    names = ["input_ids", "token_type_ids", "attention_mask"]
    rows = encode.explode_features(byte_chunks(spark, sf_dir), names, ["story_id"])
    return rows.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("tokens"), *[F.sum(n).alias(f"sum_{n}") for n in names]
    )


def parse_int_list_query(spark, sf_dir):
    written = F.concat(F.lit("["), F.array_join("input_ids", ", "), F.lit("]"))
    parsed = byte_chunks(spark, sf_dir).select(
        "story_id", "chunk_no", parse_int_list(written).alias("parsed")
    )
    total = F.aggregate("parsed", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return parsed.select(
        "story_id", "chunk_no", F.size("parsed").alias("numbers"), total.alias("total")
    )


# Shuffling and packing


def shuffle_order(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir).select("story_id", "chunk_no")
    return index.shuffle_order(chunks, ["story_id", "chunk_no"], Q.seed)


def epoch_order(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir).select("story_id", "chunk_no")
    epoch = 1
    seed = pack.epoch_seed(Q.seed, epoch, reload=True, shuffle_data=True)
    ordered = index.shuffle_order(chunks, ["story_id", "chunk_no"], seed)
    return ordered.withColumn("epoch", F.lit(epoch))


def pack_groups(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir).select("story_id", "chunk_no", "length")
    groups = pack.pack_groups(chunks, PACK)
    return groups.select("story_id", "chunk_no", "idx", "group_id", "rank")


def block_rows(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", "group_id", "block_no", joined("input_ids"))


def pack_blocks(spark, sf_dir):
    return block_rows(byte_blocks(spark, sf_dir))


def pack_blocks_n_groups(spark, sf_dir):
    cfg = PackConfig(seed=Q.seed, group_mode="n_groups")
    return block_rows(pack.pack_blocks(chunk_table(spark, sf_dir), cfg))


def packing_yield(spark, sf_dir):
    return pack.packing_yield(chunk_table(spark, sf_dir), PACK)


def block_limit(spark, sf_dir):
    cfg = PackConfig(seed=Q.seed, row_limit=Q.row_limit)
    return block_rows(pack.pack_blocks(chunk_table(spark, sf_dir), cfg))


def block_lookup(spark, sf_dir):
    chosen = lambda block_id: block_id.isin(*Q.positions)
    return block_rows(pack.pack_blocks(chunk_table(spark, sf_dir), PACK, wanted=chosen))


# Minibatches


def narrow_chunks(spark, sf_dir) -> DataFrame:
    """Places and lengths of the byte chunks, without their tokens."""
    rows = byte_chunks(spark, sf_dir, as_symbols=True).select("story_id", "chunk_no", "length")
    return materialize(rows, "chunk-lengths")


def batch_plan(spark, sf_dir):
    ids = pack.block_ids(narrow_chunks(spark, sf_dir), PACK)
    return batches.batch_plan(batches.epoch_positions(ids, Q.epochs, Q.seed), TRAINING)


def batch_plan_valid(spark, sf_dir):
    ids = pack.block_ids(narrow_chunks(spark, sf_dir), PACK)
    return batches.batch_plan(batches.epoch_positions(ids, 1, shuffle=False), TRAINING)


def step_plan(spark, sf_dir):
    return batches.step_plan(batch_plan(spark, sf_dir), TRAINING)


def written_split_chunks(chunks: DataFrame) -> DataFrame:
    chunks = chunks.select("split", "story_id", "chunk_no", "length", "symbols")
    return pack.with_ids(materialize(pack.as_symbols(chunks), "chunks"))


def split_chunks(spark, sf_dir) -> DataFrame:
    """Byte chunks of the distinct stories with their split."""
    rows = records(spark, sf_dir).withColumn("text", F.replace("text", F.lit(EOS), F.lit("")))
    return tokens.tokenized_chunks(rows, Tokenizer(), PACK.context_length, as_symbols=True)


def narrow_split_chunks(spark, sf_dir) -> DataFrame:
    """Places and lengths of ``split_chunks``, which is all that plans need."""
    rows = split_chunks(spark, sf_dir).select("split", "story_id", "chunk_no", "length")
    return materialize(rows, "chunk-lengths")


def split_block_rows(blocks: DataFrame) -> DataFrame:
    return blocks.select("split", "block_id", "group_id", "block_no", joined("input_ids"))


def epoch_blocks(spark, sf_dir):
    """All blocks of the second epoch, packed anew under its seed."""
    cfg = PackConfig(seed=pack.epoch_seed(Q.seed, 1, reload=True, shuffle_data=True))
    return split_block_rows(pack.pack_blocks(written_split_chunks(split_chunks(spark, sf_dir)), cfg, by=("split",)))


def train_steps(spark, sf_dir):
    cfg = PrepConfig(pack=PACK, training=TrainingConfig(max_steps=Q.many_steps))
    return tokens.training_plan(narrow_split_chunks(spark, sf_dir), cfg)


def valid_batches(spark, sf_dir):
    return tokens.validation_plan(narrow_split_chunks(spark, sf_dir), PrepConfig(pack=PACK))


def next_token_pairs(spark, sf_dir):
    pairs = batches.next_token_pairs(byte_blocks(spark, sf_dir))
    return pairs.select("block_id", joined("inputs"), joined("targets"))


# All stages


def corpus_chunks(spark, sf_dir) -> DataFrame:
    """Selection, vocabulary and encoding of the accepted sources."""
    chosen = materialize(corpus.select_stories(raw(spark, sf_dir), CORPUS), "stories")
    rows = corpus.story_records(spread(chosen), CORPUS)
    texts = rows.where(F.col("split") == "train").select("text")
    tokenizer = bpe.train(bpe.word_counts(texts), Q.vocab_size)
    return written_split_chunks(tokens.tokenized_chunks(rows, tokenizer, PACK.context_length, as_symbols=True))


def corpus_to_blocks(spark, sf_dir):
    """All stages: the packed blocks of each split."""
    return split_block_rows(tokens.packed_blocks(corpus_chunks(spark, sf_dir), PACK))


def corpus_yield(spark, sf_dir):
    return pack.packing_yield(corpus_chunks(spark, sf_dir), PACK, by=("split",))


# Full vocabularies


def full_tokenizer(spark, sf_dir) -> Tokenizer:
    return bpe.train(word_counts(spark, sf_dir), TokenizerConfig().vocab_size)


def decode_roundtrip_8192(spark, sf_dir):
    tokenizer = full_tokenizer(spark, sf_dir)
    rows = encode.encode(records(spark, sf_dir).select("story_id", "text"), tokenizer)
    return encode.decode(rows, tokenizer, skip_special=False)


def chunk_roundtrip_8192(spark, sf_dir):
    """Chunks of the full vocabulary, put together in order and decoded."""
    tokenizer = full_tokenizer(spark, sf_dir)
    rows = records(spark, sf_dir).select("story_id", "text")
    chunks = tokens.tokenized_chunks(rows, tokenizer, PACK.context_length)
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "input_ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["input_ids"])).alias("input_ids")
    return encode.decode(chunks.groupBy("story_id").agg(ids), tokenizer, skip_special=False)


# Texts changed so that an operator has work to do


def nfkc_wide(spark, sf_dir):
    wide = F.translate("text", "aeo", "\uff41\uff45\uff4f")
    return raw(spark, sf_dir).select("story_id", nfkc(wide).alias("text"))


def story_strip_padded(spark, sf_dir):
    padded = F.concat(F.lit("\u00a0\x1c\n\u3000"), F.col("text"), F.lit("\x1f \u2003\r\n"))
    return raw(spark, sf_dir).select("story_id", strip(padded).alias("text"))


def clean_lines_padded(spark, sf_dir):
    padded = F.replace("text", F.lit("\n"), F.lit("\u00a0\r\n \x1c\n\t\r\u2003"))
    lines = clean_lines(padded)
    return raw(spark, sf_dir).select("story_id", F.posexplode(lines).alias("line_no", "line"))


def segment_marked(spark, sf_dir):
    """Two marker lines at every newline: empty stories, and tails that no marker ends."""
    marked = F.replace("text", F.lit("\n"), F.lit(f"\n{EOS}\n {EOS} \n"))
    lines = raw(spark, sf_dir).select(
        F.col("source").alias("file"),
        F.col("story_id").alias("block"),
        F.posexplode(F.split(marked, "\n")).alias("line_no", "line"),
    )
    return segment.segment_stories(lines)


def fine_split(spark, sf_dir):
    split = dedup.split_of(F.col("text"), Q.fine_ratio, Q.seed)
    return stories(spark, sf_dir).select("story_id", split.alias("split"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: raw documents to packed blocks."""
    return corpus_to_blocks(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "accepted_source_filter": accepted_source_filter,
        "story_strip": story_strip,
        "exact_dedup": exact_dedup,
        "duplicate_count": duplicate_count,
        "accepted_stories": accepted_stories,
        "train_valid_split": train_valid_split,
        "split_stats": split_stats,
        "corpus_counts": corpus_counts,
        "clean_lines": clean_lines_query,
        "story_records": story_records,
        "segment_stories": segment_stories,
        "story_index": story_index,
        "feed_batches": feed_batches,
        "story_cap": story_cap,
        "nfkc": nfkc_query,
        "pretokens": pretokens,
        "word_counts": word_counts,
        "byte_symbols": byte_symbols_query,
        "bpe_pair_counts": bpe_pair_counts,
        "bpe_merges": bpe_merges,
        "vocab": vocab,
        "encode_stories": encode_stories,
        "token_use": token_use,
        "decode_roundtrip": decode_roundtrip,
        "chunk_tokens": chunk_tokens,
        "chunk_features": chunk_features,
        "feature_rows": feature_rows,
        "parse_int_list": parse_int_list_query,
        "shuffle_order": shuffle_order,
        "epoch_order": epoch_order,
        "pack_groups": pack_groups,
        "pack_blocks": pack_blocks,
        "pack_blocks_n_groups": pack_blocks_n_groups,
        "packing_yield": packing_yield,
        "block_limit": block_limit,
        "block_lookup": block_lookup,
        "batch_plan": batch_plan,
        "batch_plan_valid": batch_plan_valid,
        "step_plan": step_plan,
        "next_token_pairs": next_token_pairs,
        "corpus_to_blocks": corpus_to_blocks,
        "corpus_yield": corpus_yield,
        "decode_roundtrip_8192": decode_roundtrip_8192,
        "chunk_roundtrip_8192": chunk_roundtrip_8192,
        "fine_split": fine_split,
        "nfkc_wide": nfkc_wide,
        "story_strip_padded": story_strip_padded,
        "clean_lines_padded": clean_lines_padded,
        "segment_marked": segment_marked,
        "epoch_blocks": epoch_blocks,
        "train_steps": train_steps,
        "valid_batches": valid_batches,
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **LLM_ORACLES}
