"""Raw documents to training sequences in five stages.

Each stage takes all that the one before it kept. All but the last return the
columns of ``documents``. Rows with a null id take part under an id made from
their text, so equal ones count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import decontamination, lines, packing, simhash, toxicity
from corpusprep.sources.scratch import materialize

#: SQL cannot express a trained model, tiling or token ids; tests use brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): ids without nulls, and the whole row beside them."""
    made = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + F.lit(1 << 62)
    key = F.coalesce(F.col("doc_id").cast("bigint"), made)
    return docs.select(key.alias("doc_id"), "text", F.struct("*").alias("row"))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled rows does not call toxic."""
    labels = toxicity.labels_table(spark, sf_dir)
    return toxicity.keep_clean(docs, toxicity.fold_model(docs, labels))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that match earlier ones; ``n_chars`` follows the text."""
    kept = lines.dedup_lines(docs)
    given = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return kept.select(*[given.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash links the one with the smallest id.

    Fingerprints are those of 3-word shingles and link at 3 bits or fewer. Rows that
    share an id but not their text are judged each for itself; of one id in one group
    the text with the smaller hash stays, then the row with the smaller one.
    """
    rows = keyed(docs)
    of = F.struct("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("row").alias("row_hash"))
    rows = rows.withColumn("of", of)
    named = rows.select(F.col("of").alias("doc_id"), "text")
    found = simhash.near_duplicates(named, simhash.SHINGLE_WORDS, simhash.MAX_DISTANCE)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("of")).distinct()
    one = rows.join(kept, "of", "left_semi").select("of", "row").dropDuplicates(["of"])
    return one.select("row.*")


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = keyed(docs)
    found = decontamination.contaminated(rows.select("doc_id", "text"), decontamination.benchmark(spark, sf_dir))
    hit = materialize(found.select("doc_id").distinct(), "contaminated")
    return rows.join(hit, "doc_id", "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_lines),
    ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
