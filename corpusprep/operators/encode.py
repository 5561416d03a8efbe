"""Text to token ids and back, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.bytelevel import EOS_ID, WORD_BREAK
from corpusprep.functions.normalize import nfkc_parts
from corpusprep.functions.pretokenize import (
    join_segments,
    segment_symbols,
    segments,
    unbroken_symbols,
)
from corpusprep.operators.bpe import Tokenizer, apply_merges, token_ids, vocab_table


def text_symbols(text: Column, tokenizer: Tokenizer) -> Column:
    """A text as byte symbols; end markers become one symbol.

    Words are set apart by word breaks if there are merges, which stay inside words.
    """
    parts = nfkc_parts(text, segments(text, tokenizer.eos))
    if not tokenizer.merges:
        return join_segments(F.transform(parts, unbroken_symbols), "")
    return join_segments(F.transform(parts, segment_symbols))


def encode(
    texts: DataFrame, tokenizer: Tokenizer, text: str = "text", name: str = "input_ids"
) -> DataFrame:
    """Replace the text column by token ids, row by row where the rows are."""
    symbols = text_symbols(F.col(text), tokenizer)
    ids = token_ids(symbols, tokenizer.merges, tokenizer.reuses_tokens())
    return texts.withColumn(name, ids).drop(text)


def encode_symbols(
    texts: DataFrame, tokenizer: Tokenizer, text: str = "text", name: str = "symbols"
) -> DataFrame:
    """``encode`` with the tokens as a string, a character each; no array is built."""
    symbols = text_symbols(F.col(text), tokenizer)
    if tokenizer.merges:
        merged = apply_merges(symbols, tokenizer.merges, tokenizer.reuses_tokens())
        symbols = F.replace(merged, F.lit(WORD_BREAK), F.lit(""))
    return texts.withColumn(name, symbols).drop(text)


def decode(
    rows: DataFrame,
    tokenizer: Tokenizer,
    ids: str = "input_ids",
    name: str = "text",
    skip_special: bool = True,
) -> DataFrame:
    """Replace token ids by text; ids that do not form whole characters give U+FFFD."""
    latin = [token.decode("latin-1") for token in tokenizer.token_bytes()]
    if skip_special:
        latin[EOS_ID] = ""
    tokens = F.lit(latin)
    pieces = F.transform(ids, lambda i: F.element_at(tokens, (i + 1).cast("int")))
    raw = F.encode(F.array_join(pieces, ""), "ISO-8859-1")
    return rows.withColumn(name, F.make_valid_utf8(raw.cast("string"))).drop(ids)


def token_use(rows: DataFrame, tokenizer: Tokenizer, ids: str = "input_ids") -> DataFrame:
    """``(token_id, token, special, uses)`` for every token of the vocabulary."""
    used = rows.select(F.explode(ids).alias("token_id")).groupBy("token_id")
    counts = used.agg(F.count(F.lit(1)).alias("uses"))
    vocab = vocab_table(rows.sparkSession, tokenizer)
    uses = F.coalesce("uses", F.lit(0)).cast("bigint")
    return vocab.join(counts, "token_id", "left").withColumn("uses", uses)


def chunk_tokens(rows: DataFrame, context_length: int, ids: str = "input_ids") -> DataFrame:
    """Cut token ids into runs of ``context_length``; the last may be short."""
    count = F.greatest(F.ceil(F.size(ids) / context_length), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    pieces = F.transform(
        starts, lambda p: F.slice(F.col(ids), p * context_length + 1, F.lit(context_length))
    )
    others = [c for c in rows.columns if c != ids]
    return rows.select(*others, F.posexplode(pieces).alias("chunk_no", ids))


def chunk_symbols(rows: DataFrame, context_length: int, symbols: str = "symbols") -> DataFrame:
    """``chunk_tokens`` for tokens that are a string."""
    whole = F.col(symbols)
    cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{context_length}}}"), F.lit(0))
    pieces = F.when(whole != "", cut).otherwise(F.array(whole))
    others = [c for c in rows.columns if c != symbols]
    return rows.select(*others, F.posexplode(pieces).alias("chunk_no", symbols))


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Add segment ids, attention mask, length and the source-text number.

    Tokens are in ``input_ids``, or in ``symbols`` as a string.
    """
    length = F.length("symbols") if "symbols" in chunks.columns else F.size("input_ids")
    return chunks.select(
        *chunks.columns,
        F.array_repeat(F.lit(0).cast("bigint"), length).alias("token_type_ids"),
        F.array_repeat(F.lit(1).cast("bigint"), length).alias("attention_mask"),
        length.cast("bigint").alias("length"),
        F.lit(0).cast("bigint").alias("overflow_to_sample_mapping"),
    )


def explode_features(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """One row per position of parallel array columns, each named as its array."""
    return rows.select(*keep, F.inline(F.arrays_zip(*names)))
