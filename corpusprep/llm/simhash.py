"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import documents, id_and_text, small_batches
from corpusprep.llm.components import connected_components
from corpusprep.sources.scratch import materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
SEGMENT_BITS = 32  # two segments; of three different bits one segment has at most one
KEYS_PER_GROUP = 1 << 20
ALL_PAIRS = 1 << 14  # members of one key that are compared directly


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash over the XXH64 of all word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words[: len(words) - size])]
    ends = accumulate((len(w) + 1 for w in words[size:]), initial=sum(map(len, words[:size])) + size - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def compute(batches):
        for batch in small_batches(batches):
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(compute, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def probe_keys(distinct: DataFrame) -> DataFrame:
    """Every fingerprint under its two segments and under all values one bit away.

    ``own`` marks the segment's own value: the table entries that probes look up.
    """
    rows = []
    ball = F.array(*[F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(SEGMENT_BITS)]])
    for number, segment in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND((1 << 32) - 1))):
        key = segment.bitwiseXOR(F.col("mask")).bitwiseXOR(F.lit(number << 33))
        rows.append(
            distinct.select("fp", F.explode(ball).alias("mask")).select(
                key.alias("key"), "fp", (F.col("mask") == 0).alias("own")
            )
        )
    return rows[0].unionByName(rows[1])


def spanning_links(values: np.ndarray, max_distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what distances of at most ``max_distance`` connect."""
    if len(values) > ALL_PAIRS:
        return ball_links(values, max_distance)
    links, left = [], list(range(1, len(values)))
    rest, reached = values[1:], [0]
    while len(rest):
        here = reached.pop()
        near = np.bitwise_count(rest ^ values[here]) <= max_distance
        if near.any():
            found = [left[i] for i in np.flatnonzero(near)]
            links += [(here, i) for i in found]
            reached += found
            left = [left[i] for i in np.flatnonzero(~near)]
            rest = rest[~near]
        if not reached and len(rest):
            reached, left, rest = [left[0]], left[1:], rest[1:]
    return links


def ball_links(values: np.ndarray, max_distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """The same connections for very many values: look up each point of every ball."""
    order = np.argsort(values)
    ordered = values[order]
    root = list(range(len(values)))
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for size in range(1, max_distance + 1):
        for bits in combinations(range(64), size):
            wanted = ordered ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
            hit = np.flatnonzero((ordered[at] == wanted) & (at > np.arange(len(at))))
            for a, b in zip(hit.tolist(), at[hit].tolist()):
                low, high = sorted((top(a), top(b)))
                if low != high:
                    root[high] = low
                    links.append((int(order[a]), int(order[b])))
    return links


def links_of_keys(keys: pd.DataFrame, max_distance: int = MAX_DISTANCE) -> pd.DataFrame:
    """Verified links among the fingerprints that meet at each key of a group."""
    keys = keys.sort_values("key", kind="stable")
    key, fp, own = keys["key"].to_numpy(), keys["fp"].to_numpy().view(np.uint64), keys["own"].to_numpy()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    useful = (sizes > 1) & np.logical_or.reduceat(own, starts)
    pairs = []
    for start, size in zip(starts[useful], sizes[useful]):
        members = fp[start : start + size]
        pairs += [(members[i], members[j]) for i, j in spanning_links(members, max_distance)]
    found = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1)}) if len(found) else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def fingerprint_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``max_distance`` (3 or less) bits apart.

    A key's members are compared in one task, which returns a spanning forest, so
    a large group of near copies gives as many links as members, not all pairs.
    """
    count = distinct.count()
    groups = max(1, -(-count * 2 * (SEGMENT_BITS + 1) // KEYS_PER_GROUP))
    dealt = probe_keys(distinct).withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(lambda g: links_of_keys(g, max_distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach.

    Texts link if the fingerprints of their shingles differ in ``max_distance`` bits or
    fewer; two segments and balls of one bit reach at most 3.

    Null and empty texts share fingerprint zero and are linked like any other.
    Repeated rows give a row each. A null id takes part but is never the smallest,
    so a component of null ids alone has a null ``component_id``. Identical
    fingerprints collapse before the search, whatever their number.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("two segments with balls of one bit find distances up to 3")
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialize(distinct, "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), max_distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
