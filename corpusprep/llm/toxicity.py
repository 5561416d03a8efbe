"""Toxicity by multiple-instance learning: sentences are scored, documents labelled."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import documents, hash_map, id_and_text, in_map, small_batches
from corpusprep.sources.scratch import materialize

#: At most about this many labelled documents of each label fit the model.
SAMPLE_PER_LABEL = 6000
#: Features known to the model: those most telling among all labelled documents.
VOCABULARY = 20_000
ROUNDS = 300
COUNTED_TOGETHER = 1000  # documents whose features a task counts before it passes them on
RATE = 0.3
DECAY = 1e-4
FIRST_BIAS = -7.0
THRESHOLD = 0.5

SENTENCE = re.compile(r"[.!?\n\r]+")
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)


def features(text: str) -> set[str]:
    """The words of a sentence and their beginnings, so that inflected forms count as one."""
    words = set(WORD.findall(text.lower()))
    return words.union(w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n)


class Model(NamedTuple):
    """Feature weights, the sentence bias, and the chance of the label without any reason."""

    weights: dict[str, float]
    bias: float
    floor: float

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with a known word."""
        out, at, text = [], 0, text or ""
        for border in SENTENCE.finditer(text + "\n"):
            start, end = at, border.start()
            at = border.end()
            if start < end:
                known = features(text[start:end]) & self.weights.keys()
                if known:
                    total = self.bias + sum(sorted(self.weights[w] for w in known))
                    out.append((start, end, 1 / (1 + np.exp(-total))))
        return out

    def combine(self, probabilities: list[float]) -> float:
        """Noisy-or: toxic unless no sentence is; ``floor`` is the chance without any."""
        clean = 1 - self.floor
        for p in probabilities:
            clean *= 1 - p
        return float(min(1.0, max(0.0, 1 - clean)))


def telling_words(labelled: DataFrame, size: int) -> list[str]:
    """Features whose document counts under both labels differ most, from all labelled rows.

    Counting covers every row; the result is bounded by ``size`` words.
    """

    def count(batches):
        for batch in batches:
            for at in range(0, len(batch), COUNTED_TOGETHER):
                some = batch.iloc[at : at + COUNTED_TOGETHER]
                bad, every = Counter(), Counter()
                for text, toxic in zip(some["text"], some["toxic"]):
                    found = features(text or "")
                    every.update(found)
                    if toxic:
                        bad.update(found)
                words = list(every)
                yield pd.DataFrame({"word": words, "bad": [bad[w] for w in words], "all": [every[w] for w in words]})

    rows = labelled.mapInPandas(count, "word string, bad bigint, all bigint")
    counts = rows.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    total = labelled.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    share = (total["bad"] or 0) / max(1, total["all"])
    # How far the count under label 1 lies from its expectation, in standard deviations.
    surprise = F.abs(F.col("bad") - F.col("all") * share) / F.sqrt(F.col("all") * F.lit(share * (1 - share)) + 1)
    top = counts.where(F.col("all") > 1).select("word", surprise.alias("s"))
    return [r.word for r in top.orderBy(F.desc("s"), "word").limit(size).collect()]


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The join of texts and labels; texts surely without a label stay out of its shuffle."""
    known = known.withColumn("h", F.xxhash64(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"])))
    marks = docs.sparkSession.sparkContext.broadcast(hash_map(known, "h"))

    def likely(batches):
        for batch in batches:
            kept = in_map(marks.value, batch["h"].to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(kept))

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, h bigint"
    # Labels grow with the corpus, so they are joined by a shuffle at every size.
    return hashed.mapInArrow(likely, schema).join(known.drop("h").hint("merge"), "doc_id").drop("h")


def fit(rows: list[tuple[str, int]], vocabulary: list[str], rate_of_label: float) -> Model:
    """Maximum likelihood of the labels under the noisy-or, by Adagrad on all rows.

    A document's probability is ``1 - (1 - floor) * prod(1 - p_sentence)``; its
    gradient reaches a sentence in proportion to how much the sentence explains.
    """
    number = {w: i for i, w in enumerate(vocabulary)}
    words, sentence_starts, sentence_doc = array("i"), array("q"), array("q")
    for doc, (text, _) in enumerate(rows):
        for sentence in SENTENCE.split(text or ""):
            known = sorted(number[w] for w in features(sentence) & number.keys())
            if known:
                sentence_starts.append(len(words))
                sentence_doc.append(doc)
                words.extend(known)
    words, starts, doc = (np.array(x) for x in (words, sentence_starts, sentence_doc))
    toxic = np.array([y for _, y in rows], float)
    # The sample has more toxic rows than the corpus; weights give both labels their share.
    share = toxic.mean() if len(toxic) else 0.5
    if 0 < share < 1:
        cost = np.where(toxic > 0, rate_of_label / share, (1 - rate_of_label) / (1 - share))
    else:
        cost = np.ones(len(toxic))
    weight, seen = np.zeros(len(vocabulary)), np.full(len(vocabulary), 1e-8)
    bias, bias_seen, floor = FIRST_BIAS, 1e-8, min(0.2, max(1e-3, rate_of_label / 4))
    length = np.diff(np.r_[starts, len(words)])
    for _ in range(ROUNDS if len(starts) else 0):
        score = bias + np.add.reduceat(weight[words], starts)
        p = 1 / (1 + np.exp(-score))
        clean = np.full(len(rows), np.log1p(-floor))
        np.add.at(clean, doc, np.log1p(-np.minimum(p, 1 - 1e-12)))
        all_clean = np.minimum(np.exp(clean), 1 - 1e-9)
        # d(log likelihood)/d(score): -p if the label is 0, p * clean / (1 - clean) if it is 1
        push = p * np.where(toxic[doc] > 0, all_clean[doc] / (1 - all_clean[doc]), -1.0) * cost[doc]
        step = np.bincount(words, np.repeat(push, length), len(vocabulary)) / len(rows) - DECAY * weight
        seen += step**2
        weight += RATE * step / np.sqrt(seen)
        bias_step = push.sum() / len(rows)
        bias_seen += bias_step**2
        bias += RATE * bias_step / np.sqrt(bias_seen)
    return Model({w: float(weight[i]) for w, i in number.items() if weight[i]}, bias, floor)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL, vocabulary: int = VOCABULARY
) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``.

    Word counts cover all labelled rows. The weights are fitted on a bounded sample:
    of each label about ``sample`` documents, those with the smallest id hashes.
    Rows without an id, label or text teach nothing; the largest label of an id
    counts. Without labelled rows no word is known and every score is the floor.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.expr("int(toxic > 0)")).alias("toxic"))
    labelled = materialize(labelled_texts(id_and_text(docs).where("text is not null"), known), "labelled")
    counts = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, FIRST_BIAS, 0.0)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)
    rows = labelled.where(drawn).select("doc_id", "text", "toxic").collect()
    rows = sorted(((r.text, r.toxic) for r in rows), key=lambda r: (r[1], r[0]))
    words = telling_words(labelled.select("text", "toxic"), vocabulary)
    return fit(rows, words, counts.get(1, 0) / sum(counts.values()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``offending``: sentences by themselves toxic.

    ``offending`` has start, end (code points) and score of every sentence whose
    probability is at least ``THRESHOLD``, in order. Null and empty texts score the
    floor. A row each for repeated rows and null ids; no row moves.
    """

    def score(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = model.sentences(text)
                worst = [{"start": s, "end": e, "score": float(p)} for s, e, p in found if p >= THRESHOLD]
                out.append((model.combine([p for _, _, p in found]), worst))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "score": [s for s, _ in out], "offending": [w for _, w in out]}
            )

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, score double, "
        "offending array<struct<start: bigint, end: bigint, score: double>>"
    )
    return id_and_text(docs).mapInPandas(score, schema)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fold_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that are not held out."""
    return train(docs.where(~held_out()), labels.where(~held_out()))


def labels_table(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def op7_toxicity(spark, sf_dir):
    """Score, decision and offending sentences of every document."""
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, fold_model(docs, labels_table(spark, sf_dir)))
    spans = F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(spans, ",").alias("offending"),
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below ``THRESHOLD``, all columns unchanged."""

    def choose(batches):
        for batch in small_batches(batches):
            found = (model.combine([p for *_, p in model.sentences(t)]) for t in batch["text"].to_pylist())
            yield batch.filter(pa.array([score < THRESHOLD for score in found], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
