"""Benchmark decontamination by greedy string tiling over running Karp-Rabin hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import (
    NOT_ALPHANUMERIC,
    documents,
    gram_hashes,
    hash_map,
    in_map,
    inside_text,
    plain_borders,
    small_batches,
    texts_of,
    words_of,
)
from corpusprep.sources.scratch import materialize

TILE_WORDS = 5  # the shortest match that counts, and the seed
COVERAGE = 0.8  # share of an item's words that tiles must cover


def normalised(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of texts, first word of each, and their seeds' validity."""
    words = words_of(*texts_of(plain_borders(column), lower=True), NOT_ALPHANUMERIC)
    whole = inside_text(words.first, TILE_WORDS, len(words.hashes))
    return words.hashes, words.first, whole


def seeds_of(items: DataFrame) -> DataFrame:
    """``item_id``, ``place``, ``seed`` and ``words`` for every run of ``TILE_WORDS`` words."""

    def cut(batches):
        for batch in small_batches(batches):
            hashes, first, whole = normalised(batch["text"])
            seeds = gram_hashes(hashes, TILE_WORDS)
            at = np.flatnonzero(whole)
            row = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": batch["item_id"].take(pa.array(row)),
                    "place": pa.array((at - first[row]).astype(np.int64)),
                    "words": pa.array(np.diff(first)[row].astype(np.int64)),
                    "seed": pa.array(seeds[at].view(np.int64)),
                }
            )

    kind = dict(items.dtypes)["item_id"]
    return items.mapInArrow(cut, f"item_id {kind}, place bigint, words bigint, seed bigint")


def known_seeds(batches, marks: bytes):
    """``doc`` and ``seed`` for the different runs of ``TILE_WORDS`` words that the map has."""
    for batch in small_batches(batches):
        hashes, first, whole = normalised(batch["text"])
        at = np.flatnonzero(whole)
        found = gram_hashes(hashes, TILE_WORDS)[at]
        known = in_map(marks, found)
        at, found = at[known], found[known]
        row = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(np.column_stack([row.astype(np.uint64), found]), axis=0)
        yield pa.RecordBatch.from_pydict(
            {
                "doc": batch["doc"].take(pa.array(pairs[:, 0].astype(np.int64))),
                "seed": pa.array(pairs[:, 1].copy().view(np.int64)),
            }
        )


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in document, length) of the tiles.

    The longest common run of unmarked words is marked first, every non-overlapping
    match of that length in order of place, then the next longest, down to ``least``.
    The longest length is found by bisection on Karp-Rabin hashes.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)

    def runs(values: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(values) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        open_words = np.concatenate(([0], np.cumsum(free)))
        at = np.flatnonzero(open_words[size:] - open_words[:-size] == size)
        return at, gram_hashes(values, size)[at]

    def common(size: int) -> bool:
        return bool(np.isin(runs(item, free_item, size)[1], runs(doc, free_doc, size)[1]).any())

    found, longest = [], min(len(item), len(doc))
    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        longest = low
        if longest < least:
            break
        at_item, of_item = runs(item, free_item, longest)
        at_doc, of_doc = runs(doc, free_doc, longest)
        shared = np.intersect1d(of_item, of_doc)
        places: dict[int, list[int]] = {}
        for place, value in zip(at_doc[np.isin(of_doc, shared)].tolist()[::-1], of_doc[np.isin(of_doc, shared)].tolist()[::-1]):
            places.setdefault(value, []).append(place)
        for i, value in zip(at_item.tolist(), of_item.tolist()):
            while value in places and places[value] and free_item[i : i + longest].all():
                j = places[value].pop()
                if free_doc[j : j + longest].all() and (item[i : i + longest] == doc[j : j + longest]).all():
                    free_item[i : i + longest] = free_doc[j : j + longest] = False
                    found.append((i, j, longest))
        longest -= 1
    return found


def contaminated(
    docs: DataFrame, items: DataFrame, coverage: float = COVERAGE
) -> DataFrame:
    """Pairs ``doc_id``, ``item_id``, ``covered``, ``words``, ``coverage``, ``tiles``.

    A document is contaminated by an item if tiles of at least ``TILE_WORDS`` words
    cover at least ``coverage`` of the item's words, in whatever order they stand.
    Words are lower-cased runs of letters, marks and digits of any script. Items with
    fewer words than a tile and null texts match nothing. Of rows that share an id, the
    text that covers most counts (then the greatest ``tiles`` as text), so there is one
    row per document id and item text; a null id is an id like any other.

    Seeds are joined first: tasks drop the runs that the seed map excludes, and a
    pair goes on only if the item's words in shared seeds reach the coverage, which
    tiles cannot exceed. The remaining texts meet by the text's digest and are tiled.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    items = items.select("item_id", "text").where("text is not null").distinct()
    items = items.withColumn("item", F.sha2("text", 256))
    seeds = materialize(seeds_of(items.select(F.col("item").alias("item_id"), "text").distinct()), "seeds")
    marks = docs.sparkSession.sparkContext.broadcast(hash_map(seeds, "seed"))

    hashed = docs.withColumn("doc", F.xxhash64("text"))
    shared = hashed.select("doc", "text").mapInArrow(lambda b: known_seeds(b, marks.value), "doc bigint, seed bigint").distinct()
    places = shared.join(seeds, "seed").select("doc", "item_id", "place", "words")
    reach = F.array_sort(F.collect_set("place"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, p: F.struct(
            (acc["n"] + p + TILE_WORDS - F.greatest(acc["to"], p)).alias("n"), (p + TILE_WORDS).alias("to")
        ),
        lambda acc: acc["n"],
    )
    near = places.groupBy("doc", "item_id").agg(reach.alias("places"), F.first("words").alias("words"))
    near = near.where(covered >= F.lit(coverage) * F.col("words")).select("doc", F.col("item_id").alias("item"))
    near = materialize(near, "near")
    item_texts = items.select("item", F.col("text").alias("item_text")).dropDuplicates(["item"])
    asked = near.join(item_texts, "item")

    def tile(batches):
        for batch in small_batches(batches):
            a, first_a, _ = normalised(batch["item_text"])
            b, first_b, _ = normalised(batch["text"])
            rows = []
            for k in range(len(batch)):
                words = a[first_a[k] : first_a[k + 1]]
                found = tiles(words, b[first_b[k] : first_b[k + 1]])
                covered = sum(n for *_, n in found)
                if covered >= coverage * len(words):
                    rows.append((k, covered, len(words), ",".join(f"{i}:{j}:{n}" for i, j, n in sorted(found))))
            frame = pd.DataFrame(rows, columns=["k", "covered", "words", "tiles"])
            chosen = pa.array(frame["k"].to_numpy(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].take(chosen),
                    "item": batch["item"].take(chosen),
                    "covered": pa.array(frame["covered"].to_numpy(np.int64)),
                    "words": pa.array(frame["words"].to_numpy(np.int64)),
                    "coverage": pa.array(frame["covered"].to_numpy(float) / frame["words"].to_numpy(float)),
                    "tiles": pa.array(frame["tiles"].astype(str).tolist(), pa.string()),
                }
            )

    kind = dict(docs.dtypes)["doc_id"]
    pairs = hashed.join(asked, "doc").select("doc_id", "text", "item", "item_text")
    schema = f"doc_id {kind}, item string, covered bigint, words bigint, coverage double, tiles string"
    best = F.max(F.struct("covered", "tiles", "words", "coverage")).alias("best")
    found = pairs.mapInArrow(tile, schema).groupBy("doc_id", "item").agg(best).select("doc_id", "item", "best.*")
    return found.join(items.select("item_id", "item"), "item").select(
        "doc_id", "item_id", "covered", "words", "coverage", "tiles"
    )


def benchmark(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")


def op5_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item, with the item and its coverage."""
    found = contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select("doc_id", "item_id", "covered", "words", "coverage")
