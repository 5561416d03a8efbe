"""Helpers that several operators share: table access and vectorised word hashes."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.sources.scratch import materialize

NULL_ID = -(2**63)  # stands for a null id inside arrays; sorts before every other id
CHUNK_BYTES = 1 << 20
WORD_CHUNK = 1 << 18  # bytes that are cut into words at once
BASE = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so no other column can clash."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def bucket_count(docs: DataFrame, bytes_each: int) -> int:
    """Buckets of about ``bytes_each`` bytes of text; follows the input at any size."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // bytes_each))


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents dealt by a hash of their id; equal plans share this one shuffle."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    keyed = docs.select("doc_id", "text", bucket.alias("b"))
    return keyed.repartition(buckets, "b")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    factors = np.full(max(n, 1), base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def texts_of(column: pa.ChunkedArray | pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's bounds in them; null is empty."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(bounds[-1])
    data = np.frombuffer(data, np.uint8, size) if size else np.zeros(0, np.uint8)
    return data[int(bounds[0]) :], bounds - bounds[0]


def plain_borders(column: pa.ChunkedArray | pa.Array) -> pa.ChunkedArray | pa.Array:
    """Texts with a blank for every run of non-ASCII characters other than letters, digits and marks.

    Curly quotes, long dashes and no-break spaces then separate words as ASCII does.
    """
    column = pc.fill_null(column, "")
    if pc.all(pc.string_is_ascii(column)).as_py() is not False:
        return column
    return pc.replace_substring_regex(column, BORDERS, " ")


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Integer ids, with null as ``NULL_ID``."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy()


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NULL_ID)


def small_batches(batches, column: str = "text", size: int = 2 * CHUNK_BYTES):
    """Arrow batches cut to about ``size`` bytes of text, so that arrays per word stay small."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy()
        for a, b in chunks(np.concatenate(([0], np.cumsum(length, dtype=np.int64))), size):
            yield batch.slice(a, b - a)
        del batch, length
        pa.default_memory_pool().release_unused()  # workers live on after their task


class Words(NamedTuple):
    """Words of many texts in order: byte bounds, hash, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # one more entry than texts


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BORDERS = r"[^\x00-\x7F\p{L}\p{N}\p{M}]+"
NOT_ALPHANUMERIC = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def chunks(bounds: np.ndarray, size: int = CHUNK_BYTES):
    """Runs of rows with about ``size`` bytes each; a longer row is a run of its own."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        to = max(at + 1, min(to, n))
        yield at, to
        at = to


@cache
def places_of_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse for the places in ``WORD_CHUNK`` bytes."""
    return powers(BASE, WORD_CHUNK), powers(inverse(BASE), WORD_CHUNK)


def words_of(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Split rows at separator bytes and hash every word by a polynomial of its bytes."""
    starts, ends, hashes, counts, found = [], [], [], [np.zeros(1, np.int64)], 0
    for a, b in chunks(bounds, WORD_CHUNK):
        lo, hi = int(bounds[a]), int(bounds[b])
        part = data[lo:hi]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~separator[part]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = turns[::2], turns[1::2]
        edge = np.unique(bounds[a + 1 : b] - lo)
        edge = edge[inside[edge] & inside[edge + 1]]  # a word ends and another starts
        if len(edge):
            s, e = (np.sort(np.concatenate([x, edge]), kind="stable") for x in (s, e))
        if len(s):
            power, back = places_of_bytes()
            if len(part) > WORD_CHUNK:
                power, back = powers(BASE, len(part)), powers(inverse(BASE), len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[part] * power[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
        counts.append(np.searchsorted(s, bounds[a + 1 : b + 1] - lo) + found)
        found += len(s)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Words(join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64), np.concatenate(counts))


def gram_hashes(hashes: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Rolling Karp-Rabin hash of every ``n`` neighbouring values, across text borders too."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64(base)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64)))
    return mix((total[n:] - total[:-n]) * powers(inverse(base), len(hashes) - n + 1))


def inside_text(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For every run of ``n`` words, whether it lies in one text."""
    runs = max(0, total - n + 1)
    left = np.repeat(first[1:], np.diff(first))[:runs]
    return np.arange(runs) + n <= left


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal significance together, which shuffle compression shortens."""
    each = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    out = np.empty(each.shape[::-1], np.uint8)
    for k in range(len(out)):
        out[k] = each[:, k]
    return out.tobytes()


def from_planes(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    out = np.empty((len(blob) // width, width), np.uint8)
    for k, plane in enumerate(np.frombuffer(blob, np.uint8).reshape(width, len(out))):
        out[:, k] = plane
    return out.reshape(-1).view(kind)


MAP_BITS = 24


def hash_map(rows: DataFrame, column: str) -> bytes:
    """A bit for the low ``MAP_BITS`` bits of every hash in ``column``: 2 MB for any table.

    A value whose bit is not set is not in the table, so tasks can drop most rows
    before a join; as the table grows fewer are dropped, and the join stays exact.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = rows.select(low.alias("h")).groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 64, "<i8")
    for row in words.collect():
        out[row["at"]] = row["bits"]
    return out.tobytes()


def in_map(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    low = hashes & np.uint64((1 << MAP_BITS) - 1)
    byte = np.frombuffer(bits, np.uint8)[low >> np.uint64(3)]
    return (byte >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


HOT_SHARE = 1000  # a key of more than 1/1000 of the rows is hot; there are fewer than 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``table``, whose keys are unique, without one task for a hot key.

    The entries of hot keys are broadcast, all others are shuffled. ``rows`` is read
    three times and should be a written table.
    """
    total = rows.count()
    hot = rows.groupBy(*keys).count().where(F.col("count") * HOT_SHARE > total).select(*keys)
    hot = F.broadcast(materialize(hot, "hot"))
    few = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(hot, keys, "left_anti").join(table, keys))
