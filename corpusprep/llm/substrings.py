"""Exact removal of repeated word windows, found by Karp-Rabin hashes."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import (
    bucket_count,
    bucketed,
    documents,
    from_planes,
    gram_hashes,
    id_and_text,
    id_array,
    ids_of,
    inside_text,
    planes,
    texts_of,
    words_of,
)

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
BUCKET_BYTES = 8 << 20
OTHER_BASE = 0xAF251AF3B0F025B5

ANCHORS = "part int, b int, anchors binary"
WINDOWS = "part int, b int, hashes binary, checks binary, docs binary"


class Bucket:
    """All windows of one bucket of documents, in the order of (doc_id, text, position)."""

    def __init__(self, table: pa.Table, window: int) -> None:
        order = pc.sort_indices(
            table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"
        )
        table = table.take(order)
        self.ids = ids_of(table["doc_id"])
        self.data, bounds = texts_of(table["text"])
        self.words = words_of(self.data, bounds)
        hashes = self.words.hashes
        whole = inside_text(self.words.first, window, len(hashes))
        self.at = np.flatnonzero(whole)  # first word of every window
        self.window = window
        self.hash = gram_hashes(hashes, window)[self.at]
        self.check = gram_hashes(hashes, window, OTHER_BASE)[self.at].astype(np.uint32)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.words.first))[self.at]

    def anchors(self) -> np.ndarray:
        """Of every window, the smallest hash of the short runs of words in it."""
        size = min(ANCHOR_WORDS, self.window)
        least = gram_hashes(self.words.hashes, size)
        span, have = self.window - size + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: -(span - have)], least[span - have :])
        return least[self.at]


def part_slices(ordered: np.ndarray, parts: int):
    """(part, slice) of ascending hashes, by equal ranges of the hash."""
    edges = [np.uint64(((1 << 64) * p) // parts) for p in range(1, parts)]
    cuts = [0, *np.searchsorted(ordered, np.array(edges, np.uint64)).tolist(), len(ordered)]
    for part in range(parts):
        if cuts[part] < cuts[part + 1]:
            yield part, slice(cuts[part], cuts[part + 1])


def rows(schema: str, values: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith("int") else pa.binary() for c in schema.split(", ")]
    columns = list(zip(*values)) if values else [[] for _ in names]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def bucket_of(table: pa.Table) -> int:
    return table["b"][0].as_py()


def blob(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [from_planes(x.as_py(), kind) for x in table[name]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def repeated_anchors(table: pa.Table) -> pa.Table:
    """For every bucket, those of its anchors that other buckets have as well."""
    blobs = [from_planes(x.as_py(), np.uint64) for x in table["anchors"]]
    values, counts = np.unique(np.concatenate(blobs), return_counts=True)
    values = values[counts > 1]
    found = [(0, b.as_py(), planes(kept)) for b, x in zip(table["b"], blobs) if len(kept := x[np.isin(x, values)])]
    return rows(ANCHORS, found)


def foreign_windows(table: pa.Table) -> pa.Table:
    """For every bucket, those of its windows that start earlier in another bucket."""
    hashes, checks, docs = (blob(table, n, k) for n, k in (("hashes", np.uint64), ("checks", np.uint32), ("docs", np.int64)))
    sizes = [len(x.as_py()) // 8 for x in table["hashes"]]
    source = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((docs, checks, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    later = np.zeros(len(hashes), bool)
    later[order[1:]] = same
    buckets = [b.as_py() for b in table["b"]]
    found = [(0, buckets[k], planes(hashes[mine])) for k in range(len(sizes)) if (mine := later & (source == k)).any()]
    return rows(ANCHORS, found)


def repeated_windows(docs: DataFrame, window: int = WINDOW_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (text).

    Words covered by a window of ``window`` words whose sequence also starts
    earlier (smaller doc_id, or earlier in the same document) are removed; kept
    words are joined by one space. Every window is hashed; a window occurs again in
    another bucket only if the smallest short run in it does, so only windows that
    pass this exact test are shuffled and counted. Inside a bucket windows are
    compared directly, so a passage in a third of all documents sends one entry
    per bucket. Overlapping windows merge into maximal intervals by a running sum.

    Null, empty and short texts lose nothing. A null id comes before all others.
    Rows that share an id are ordered by their text; of equal rows the first is
    kept. The documents are shuffled once, by bucket, for all three passes.
    """
    docs = id_and_text(docs)
    id_type = dict(docs.dtypes)["doc_id"]
    parts = bucket_count(docs, bucket_bytes)
    dealt = bucketed(docs, parts)

    def send_anchors(table: pa.Table) -> pa.Table:
        found = np.unique(Bucket(table, window).anchors())
        return rows(ANCHORS, [(p, bucket_of(table), planes(found[s])) for p, s in part_slices(found, parts)])

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return rows(WINDOWS, [])
        bucket = Bucket(table, window)
        asked = np.flatnonzero(np.isin(bucket.anchors(), blob(answers, "anchors", np.uint64)))
        hashes, first = np.unique(bucket.hash[asked], return_index=True)
        first = asked[first]
        checks, ids = bucket.check[first], bucket.ids[bucket.doc[first]]
        return rows(
            WINDOWS,
            [(p, bucket_of(table), planes(hashes[s]), planes(checks[s]), planes(ids[s])) for p, s in part_slices(hashes, parts)],
        )

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return kept_rows(np.zeros(0, np.int64), [], [], [])
        bucket = Bucket(table, window)
        _, first, group = np.unique(bucket.hash, return_index=True, return_inverse=True)
        gone = first[group.reshape(-1)] != np.arange(len(group))
        gone |= np.isin(bucket.hash, blob(answers, "anchors", np.uint64))
        change = np.zeros(len(bucket.words.hashes) + 1, np.int64)
        np.add.at(change, bucket.at[gone], 1)
        np.add.at(change, bucket.at[gone] + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        first_word = bucket.words.first
        removed = np.diff(np.concatenate(([0], np.cumsum(covered)))[first_word])
        data, kept = bucket.data.tobytes(), []
        starts, ends = bucket.words.starts, bucket.words.ends
        for i in range(len(bucket.ids)):
            mine = slice(first_word[i], first_word[i + 1])
            left = ~covered[mine]
            kept.append(b" ".join([data[s:e] for s, e in zip(starts[mine][left].tolist(), ends[mine][left].tolist())]).decode())
        return kept_rows(bucket.ids, np.diff(first_word), removed, kept)

    def kept_rows(ids, n_words, n_removed, kept) -> pa.Table:
        columns = {
            "doc_id": id_array(ids),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.string()),
        }
        return pa.table(columns)

    anchors = dealt.groupBy("b").applyInArrow(send_anchors, ANCHORS)
    known = anchors.groupBy("part").applyInArrow(repeated_anchors, ANCHORS).select("b", "anchors")
    windows = dealt.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(send_windows, WINDOWS)
    foreign = windows.groupBy("part").applyInArrow(foreign_windows, ANCHORS).select("b", "anchors")
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    kept = dealt.groupBy("b").cogroup(foreign.groupBy("b")).applyInArrow(remove, out)
    return kept.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op8_substrings(spark, sf_dir):
    """Words removed from every document and the digest of what is kept."""
    kept = repeated_windows(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - {WINDOW_WORDS - 1})) AS pos0, words FROM w
  WHERE len(words) >= {WINDOW_WORDS}
), h AS (
  SELECT doc_id, pos0, row_number() OVER (
    PARTITION BY array_to_string(words[pos0:pos0 + {WINDOW_WORDS - 1}], ' ') ORDER BY doc_id, pos0
  ) > 1 AS again
  FROM s
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos0, pos0 + {WINDOW_WORDS - 1})) AS pos FROM h WHERE again
), p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM p ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
