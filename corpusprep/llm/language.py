"""Language identification: nearest of several centroids per language by cosine."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import documents

SIZES = (1, 2, 3)  # characters of an n-gram
SLOTS = 4096  # n-grams are hashed to this many components
CENTROIDS = 4  # at most, per language
SMALLEST_CLUSTER = 0.1  # share of a language's sample that every cluster holds at least
SAMPLE_PER_LANGUAGE = 1000  # about this many documents of a language fit its centroids
REJECT_QUANTILE = 0.999  # farther than so much of the sample means rejected
SLICE = 1 << 20  # characters handled at once
UNKNOWN = "und"

LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def letters_of(text: str | None) -> np.ndarray:
    """Lower-cased code points with a blank for each run of anything but letters."""
    codes = np.frombuffer((" " + (text or "") + " ").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(LETTER[codes], codes, 32)
    return codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]


def count_grams(codes: np.ndarray) -> np.ndarray:
    """How often each slot's n-grams occur; slices bound the memory, not the text."""
    counts = np.zeros(SLOTS, np.int64)
    for at in range(0, len(codes), SLICE):
        for size in SIZES:
            part = codes[max(0, at - size + 1) : at + SLICE].astype(np.uint64)
            if len(part) < size:
                continue
            grams = np.full(len(part) - size + 1, size, np.uint64)
            for i in range(size):
                grams = (grams ^ part[i : len(part) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                grams ^= grams >> np.uint64(29)
            counts += np.bincount((grams % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length one."""
    weights = np.log1p(counts) * idf
    norm = np.linalg.norm(weights)
    return weights / norm if norm else weights


class Model(NamedTuple):
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    radius: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine with its nearest centroid, rejected)"""
        codes = letters_of(text)
        if not LETTER[codes].any() or not len(self.languages):
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ vector(count_grams(codes), self.idf)
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[best], score, bool(1 - score > self.radius[best])


def lloyd(vectors: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from given centres: centres and each vector's nearest one."""
    centres = centres.copy()
    for _ in range(rounds):
        member = np.argmax(vectors @ centres.T, axis=1)
        for k in range(len(centres)):
            if (member == k).any():
                middle = vectors[member == k].sum(axis=0)
                centres[k] = middle / (np.linalg.norm(middle) or 1)
    return centres, np.argmax(vectors @ centres.T, axis=1)


def unit_means(vectors: np.ndarray, member: np.ndarray) -> np.ndarray:
    means = np.array([vectors[member == k].sum(axis=0) for k in range(member.max() + 1)])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    return means / np.where(norms == 0, 1, norms)


def halves(vectors: np.ndarray, least: int, rounds: int = 12) -> np.ndarray | None:
    """0 or 1 for every vector, each at least ``least`` times; None if all are equal.

    The cut starts at the median along the direction of greatest spread and is
    refined by k-means, unless that leaves one side too small.
    """
    spread = vectors - vectors.mean(axis=0)
    direction = spread[np.argmax((spread**2).sum(axis=1))]
    for _ in range(rounds):
        direction = spread.T @ (spread @ direction)
        norm = np.linalg.norm(direction)
        if norm < 1e-9:
            return None
        direction = direction / norm
    cut = np.zeros(len(vectors), np.int64)
    cut[np.argsort(spread @ direction, kind="stable")[len(vectors) // 2 :]] = 1
    _, refined = lloyd(vectors, unit_means(vectors, cut), rounds)
    return refined if np.bincount(refined, minlength=2).min() >= least else cut


def cluster(vectors: np.ndarray, most: int = CENTROIDS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Bisecting spherical k-means: up to ``most`` centroids and their radii.

    The cluster with the largest sum of distances is cut in two until there are
    enough; a side holds at least ``SMALLEST_CLUSTER`` of all vectors, so outliers
    make no centroid of their own. Only equal or very few vectors leave one centroid.
    """
    least = max(1, math.ceil(SMALLEST_CLUSTER * len(vectors)))
    member, whole = np.zeros(len(vectors), np.int64), set()
    while member.max() + 1 < most:
        distance = 1 - (vectors * unit_means(vectors, member)[member]).sum(axis=1)
        loose = np.bincount(member, distance)
        small = np.bincount(member) < 2 * least
        order = [k for k in np.argsort(-loose, kind="stable").tolist() if not small[k] and k not in whole]
        if not order:
            break
        at = np.flatnonzero(member == order[0])
        side = halves(vectors[at], least)
        if side is None:
            whole.add(order[0])
        else:
            member[at[side == 1]] = member.max() + 1
    centres, found = lloyd(vectors, unit_means(vectors, member), rounds)
    if np.bincount(found, minlength=len(centres)).min() >= least:
        member = found
    else:
        centres = unit_means(vectors, member)
    distance = 1 - (vectors * centres[member]).sum(axis=1)
    radius = [float(np.quantile(distance[member == k], REJECT_QUANTILE)) for k in range(len(centres))]
    return centres, np.array(radius)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents per slot, of the whole table; the driver gets SLOTS rows."""

    def count(batches):
        total, found = 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found += count_grams(letters_of(text)) > 0
                total += 1
        yield pd.DataFrame({"slot": range(-1, SLOTS), "n": [total, *found]})

    sums = texts.select("text").mapInPandas(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(SLOTS + 1, np.int64)
    for row in sums.collect():
        found[row.slot + 1] = row.n
    return int(found[0]), found[1:]


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on ``docs(doc_id, text, lang)``; rows with a null text or lang teach nothing.

    Document frequencies cover all rows. The centroids of a language are fitted in
    one task on the vectors of about ``sample`` of its documents, those with the
    smallest hashes; texts become vectors of a fixed size before they meet.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null")
    total, found = document_frequencies(known)
    idf = np.log((1 + total) / (1 + found)) + 1
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(sample) / F.col("n")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)

    def embed(batches):
        for batch in batches:
            codes = [letters_of(t) for t in batch["text"]]
            vectors = [vector(count_grams(c), idf).astype("<f4").tobytes() if LETTER[c].any() else None for c in codes]
            yield pd.DataFrame({"lang": batch["lang"], "vector": vectors}).dropna()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = [np.frombuffer(v, "<f4") for v in sorted(rows["vector"])]
        centres, radius = cluster(np.array(vectors))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.astype("<f4").tobytes() for c in centres], "radius": radius})

    fitted = (
        known.join(F.broadcast(counts), "lang").where(drawn).select("lang", "text")
        .mapInPandas(embed, "lang string, vector binary")
        .groupBy("lang").applyInPandas(fit, "lang string, centroid binary, radius double").collect()
    )
    fitted.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    centroids = np.array([np.frombuffer(r.centroid, "<f4") for r in fitted]).reshape(-1, SLOTS)
    return Model(idf, [r.lang for r in fitted], centroids, np.array([r.radius for r in fitted]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` for every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0. ``rejected`` says
    that the nearest centroid is farther away than ``REJECT_QUANTILE`` of the
    documents that made it, so the text may be in none of the languages. Ties go to
    the first language in order. Repeated rows and null ids give a row each.
    """

    def predict(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch["text"]]
            names = ["lang_pred", "score", "rejected"]
            out = pd.DataFrame(found, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text").mapInPandas(predict, schema)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_language(spark, sf_dir):
    """Language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
