"""Exact deduplication by two-pass Bloom filtering, with column functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import documents
from corpusprep.sources.scratch import materialize

BLANKS = r"[\x20\x09-\x0D]+"
PROBES = 3  # bits of a row in the filter
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25  # size of the filter, at most 4 MB unless a caller asks for more
BITS_PER_ROW = 16
HOT_SHARE = 1000  # groups of more than 1/1000 of the rows are hot; there are fewer than 1000


def normalised(text: Column) -> Column:
    """The text with every run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def filter_bits(rows: int, most: int) -> int:
    """Bits of the filter, a power of two that follows the rows up to ``most``."""
    return min(most, max(LEAST_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length()))


def positions(bits: int) -> list[Column]:
    """The bits of a row's digest."""
    return [F.xxhash64("digest", F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def repeated_bits(rows: DataFrame, bits: int) -> DataFrame:
    """First pass: one row with the filter of all bits that were set twice or more.

    Bits are counted where the rows are before they are shuffled, so a digest of a
    third of all rows sends one row per task. ``words`` holds 64 bits an entry.
    """
    set_bits = rows.select(F.explode(F.array(*positions(bits))).alias("bit"))
    twice = set_bits.groupBy("bit").count().where("count > 1")
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = twice.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(mask).alias("word"))
    every = rows.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("word"))
    dense = words.unionByName(every).groupBy("at").agg(F.bit_or("word").alias("word"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "word")))
    return dense.agg(F.transform(in_order, lambda x: x["word"]).alias("words"))


def possibly_repeated(rows: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """Second pass: ``rows`` with ``maybe``, false where the digest surely occurs once in ``digests``."""
    words = materialize(repeated_bits(digests, bits), "filter").scalar()
    hits = [
        F.getbit(F.get(F.col("words"), F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        for p in positions(bits)
    ]
    return rows.withColumn("words", words).withColumn("maybe", reduce(Column.__and__, hits)).drop("words")


def exact_copies(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, one row per row of ``docs``.

    Texts are equal if they are identical after every run of ASCII blanks has become
    one space; a null text is empty. Of equal texts the row with the smallest id stays,
    of rows that share it too exactly one. A null id comes after all others, so
    ``keep_id`` is null only where all ids of a group are.

    The digests are written once. The first pass sets ``PROBES`` bits of a Bloom filter
    for each and keeps the bits set twice; the second lets every row whose bits are not
    all kept pass straight through. Only the others are shuffled, as digests and ids,
    after they were combined where they are. Groups of more than 1/``HOT_SHARE`` of the
    rows, fewer than ``HOT_SHARE``, are broadcast to their rows instead. The filter has
    ``BITS_PER_ROW`` bits a row but no more than ``most_bits``, a power of two: with very
    many rows more of them are shuffled without need; the result is the same.
    """
    rows = docs.select(
        "doc_id",
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "digests")
    total = rows.count()
    marked = materialize(possibly_repeated(rows, rows, filter_bits(total, most_bits)), "marked")
    once = marked.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    maybe = marked.where("maybe").select("doc_id", "row", "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = materialize(maybe.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    hot = groups.where(F.col("group_size") * HOT_SHARE > total)
    cold = groups.where(F.col("group_size") * HOT_SHARE <= total)
    in_hot = maybe.join(F.broadcast(hot), "digest")
    in_cold = maybe.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    met = in_hot.unionByName(in_cold).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest"
    )
    return once.unionByName(met).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rule of ``exact_copies``.

    Rows whose digest surely occurs once are not shuffled. Of the others each task
    keeps one row per text before the shuffle, so a large group sends a row per task.
    Of rows that share id and text the one with the smallest JSON form stays.
    """
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rows = docs.select(F.struct("*").alias("given"), digest.alias("digest"))
    digests = materialize(rows.select("digest"), "digests")
    marked = possibly_repeated(rows, digests, filter_bits(digests.count(), most_bits))
    once = marked.where("not maybe").select("given.*")
    order = F.struct(F.col("given.doc_id").isNull(), F.col("given.doc_id"), F.to_json("given"))
    one = marked.where("maybe").groupBy("digest").agg(F.min_by("given", order).alias("given"))
    return once.unionByName(one.select("given.*"))


def op11_exact(spark, sf_dir):
    """The group of every document among those with the same text."""
    return exact_copies(documents(spark, sf_dir))


OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT
    doc_id,
    min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
    text_sha256
FROM texts
"""
