"""Line deduplication by an exact set-similarity join over the lines' words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import (
    BASE,
    NOT_ALPHANUMERIC,
    documents,
    from_planes,
    hash_map,
    ids_of,
    in_map,
    lookup,
    mix,
    planes,
    small_batches,
    texts_of,
    words_of,
)
from corpusprep.llm.phrases import FAN_BITS, Summary
from corpusprep.sources.scratch import materialize

SIMILARITY = (4, 5)  # 0.8 as a fraction, so that all bounds are exact
COUNTERS = 1 << 18  # of word frequencies; any order is a right one, a good one is fast
COUNTER_SLICES = 64
FREQUENT = 1 << 14  # a word of more than this part of all words may be dealt over slices
WORD_BYTES = 5  # of a word's hash in the table of lines
PART_WORDS = 10_000_000  # words of the input for each group of postings
FLUSH = 300_000  # postings that a task sorts before it sends them
PAIRS = 1 << 16  # pairs of postings that a task compares at once
MOST_WIDTH = 64  # 64-bit words of a signature at most
SLICE_LINES = 1 << 13  # a word that more lines may hold has its lines dealt over slices
GUEST, SLICED = 1, 2

KINDS = {"tokens": "<u4", "docs": "<i8", "lines": "<u4", "sizes": "<u4", "places": "<u4", "checks": "<u4", "flags": "<u1"}
POSTINGS = "part bigint, marks binary, " + ", ".join(f"{name} binary" for name in KINDS)
CANDIDATES = "doc bigint, line bigint, other_doc bigint, other_line bigint, more boolean, sliced boolean"
LINES = "doc bigint, line bigint, ver bigint, hash bigint, words binary, slice int, count bigint"


class Lines(NamedTuple):
    """The distinct words of all lines that have words, line after line, rarest word first."""

    words: np.ndarray
    first: np.ndarray  # bounds of each line's words
    row: np.ndarray  # the text of each line
    number: np.ndarray  # of the line in its text
    hash: np.ndarray  # of the set


def lines_of(column, rank: np.ndarray | None = None) -> Lines:
    """Words are lower-case runs of letters and digits; ``rank`` orders them, then the hash."""
    data, bounds = texts_of(column, lower=True)
    found = words_of(data, bounds, NOT_ALPHANUMERIC)
    ends = np.flatnonzero(data == 10)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(found.first))
    before = np.searchsorted(ends, found.starts)
    line = before + row
    slot = (found.hashes & np.uint64(COUNTERS - 1)).astype(np.int64)
    order = word_order(line, slot if rank is None else rank[slot], found.hashes)
    words, sorted_line = found.hashes[order], line[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (sorted_line[1:] != sorted_line[:-1])
    words, order = words[new], order[new]
    line = line[order]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    at = order[first]
    number = before[at] - np.searchsorted(ends, bounds[:-1])[row[at]]
    total = np.add.reduceat(mix(words), first) if len(first) else np.zeros(0, np.uint64)
    return Lines(words, np.append(first, len(words)), row[at], number, mix(total))


def word_order(line: np.ndarray, rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by line, rank and hash; one packed key does unless two words share it."""
    if len(line) and line[-1] < 1 << 22:
        packed = (line.astype(np.uint64) << np.uint64(42)) | (rank.astype(np.uint64) << np.uint64(24))
        packed |= hashes >> np.uint64(40)
        order = np.argsort(packed)
        key, word = packed[order], hashes[order]
        if not ((key[1:] == key[:-1]) & (word[1:] != word[:-1])).any():
            return order
    return np.lexsort((hashes, rank, line))


def widths(sizes: np.ndarray) -> np.ndarray:
    """64-bit words in the signature of a set: about a bit for each member, a power of two."""
    return np.minimum(MOST_WIDTH, 2 ** np.ceil(np.log2(np.maximum(1, sizes / 64))).astype(np.int64))


def signatures(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's parity of members per bit, one set after the other, and where they start.

    Two sets differ in at least as many members as their signatures do in bits. A
    wide signature folds to a narrow one by the exclusive or of its halves.
    """
    sizes = np.diff(first)
    width = widths(sizes)
    start = np.concatenate(([0], np.cumsum(width)))
    bit = (words >> np.uint64(20)) & np.repeat((64 * width - 1).astype(np.uint64), sizes)
    out = np.zeros(start[-1], np.uint64)
    at = np.repeat(start[:-1], sizes) + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return out, start


class Folded:
    """Signatures of all widths, to compare any two at the narrower one's width."""

    def __init__(self, marks: np.ndarray, sizes: np.ndarray) -> None:
        self.width = widths(sizes)
        start = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wider, w = None, int(self.width.max(initial=1))
        while w:
            rows = np.flatnonzero(self.width >= w)
            place = np.full(len(sizes), -1)
            place[rows] = np.arange(len(rows))
            table = np.zeros((len(rows), w), np.uint64)
            own = self.width[rows] == w
            table[own] = marks[start[rows[own]][:, None] + np.arange(w)]
            if wider is not None:
                both, known = wider
                folded = both[:, :w] ^ both[:, w:]
                table[~own] = folded[known[rows[~own]]]
            self.tables[w] = wider = (table, place)
            w //= 2

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            table, place = self.tables[int(w)]
            out[mine] = np.bitwise_count(table[place[a[mine]]] ^ table[place[b[mine]]]).sum(axis=1)
        return out


def packed(words: np.ndarray, first: np.ndarray) -> pa.Array:
    """The low ``WORD_BYTES`` bytes of each line's words."""
    data = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
    bounds = (first * WORD_BYTES).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words line after line and each line's bounds in them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = raw.reshape(-1, WORD_BYTES)
    return out.view("<u8").reshape(-1), (bounds - bounds[0]) // WORD_BYTES


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with words, and rows with the counts of words; the texts are read once.

    ``ver`` is a hash of the text, ``hash`` one of the line's set of words. Rows of counts
    have a ``slice`` of the counters, or none and a frequent word with its ``count``
    in a task: every word of more than 1/``FREQUENT`` of all words is there, short of
    at most that share.
    """

    def read(batches):
        counts = np.zeros(COUNTERS, np.int64)
        frequent = Summary(2 * FREQUENT, "<u8")
        for batch in small_batches(batches):
            found = lines_of(batch["text"])
            counts += np.bincount((found.words & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            frequent.add(*np.unique(found.words & np.uint64((1 << 8 * WORD_BYTES) - 1), return_counts=True))
            none = pa.nulls(len(found.row), pa.int64())
            columns = [
                pa.array(ids_of(batch["doc_id"])[found.row]),
                pa.array(found.number),
                batch["ver"].take(pa.array(found.row)),
                pa.array(found.hash.view(np.int64)),
                packed(found.words, found.first),
                none.cast(pa.int32()),
                none,
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINES.split(", ")])
        frequent.merge()
        often = frequent.counts * 2 * FREQUENT > counts.sum()
        words, often = frequent.keys[often].astype(np.int64), frequent.counts[often]
        blobs = [x.astype("<u8").tobytes() for x in counts.reshape(COUNTER_SLICES, -1)] if counts.any() else []
        none = pa.nulls(len(blobs) + len(words), pa.int64())
        columns = [
            none,
            none,
            none,
            pa.array([None] * len(blobs) + words.tolist(), pa.int64()),
            pa.array([*blobs, *[None] * len(words)], pa.binary()),
            pa.array([*range(len(blobs)), *[None] * len(words)], pa.int32()),
            pa.array([None] * len(blobs) + often.tolist(), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINES.split(", ")])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("ver"))
    return materialize(rows.mapInArrow(read, LINES), "lines")


def word_ranks(table: DataFrame) -> tuple[np.ndarray, dict[int, int], int]:
    """The place of every counter in the order of rising counts, frequent words' slices, all words."""

    def add(batches):
        part, total = None, None
        for batch in batches:
            for number, blob in zip(batch["slice"].to_pylist(), batch["words"]):
                if number != part:
                    if part is not None:
                        yield sums(part, total)
                    part, total = number, np.zeros(COUNTERS // COUNTER_SLICES, "<u8")
                total += np.frombuffer(blob.as_py(), "<u8")
        if part is not None:
            yield sums(part, total)

    def sums(part, total):
        return pa.RecordBatch.from_pydict({"slice": pa.array([part], pa.int32()), "words": pa.array([total.tobytes()], pa.binary())})

    sent = table.where("slice is not null").select("slice", "words").repartition("slice").sortWithinPartitions("slice")
    counts = np.zeros((COUNTER_SLICES, COUNTERS // COUNTER_SLICES), np.int64)
    for row in sent.mapInArrow(add, "slice int, words binary").collect():
        counts[row.slice] = np.frombuffer(row.words, "<u8")
    counts = counts.reshape(-1)
    rank = np.empty(COUNTERS, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(COUNTERS, dtype=np.int32)
    total = int(counts.sum())
    most = F.sum("count") + total // FREQUENT
    words = table.where("count is not null").groupBy(F.col("hash").alias("word")).agg(most.alias("most"))
    least = max(SLICE_LINES, total // FREQUENT)
    slices = {r.word: -(-r.most // SLICE_LINES) for r in words.where(F.col("most") > least).collect()}
    return rank, slices, total


def prefix_sizes(sizes: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """How many of a set's rarest words any similar set must share one of."""
    num, den = similarity
    return sizes - -(-num * sizes // den) + 1


def sorted_lines(batch: pa.RecordBatch, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch of the table of lines, each line's rarest first."""
    words, first = unpacked(batch["words"])
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    slot = (words & np.uint64(COUNTERS - 1)).astype(np.int64)
    return words[word_order(line, rank[slot], words << np.uint64(64 - 8 * WORD_BYTES))], first


def with_word_in(batch: pa.RecordBatch, wanted: bytes) -> np.ndarray:
    """The lines that have a word of the map."""
    words, first = unpacked(batch["words"])
    hits = np.concatenate(([0], np.cumsum(in_map(wanted, mix(words)))))
    return np.diff(hits[first]) > 0


def postings(
    lines: DataFrame,
    rank: np.ndarray,
    slices: dict[int, int],
    levels: int,
    similarity: tuple[int, int],
    wanted: bytes | None,
    asked: bytes | None,
) -> DataFrame:
    """Prefix words with place, size and a signature of the set, dealt by the word's hash.

    Of equal sets in a batch only the first is sent: the others are no first match.
    ``wanted`` is a map of the words that are wanted, None of all. The lines of a
    frequent word are dealt over its slices; a line in the map ``asked`` is a guest
    in all other slices too, where others are not compared with it. A task sends 64
    rows for every ``FLUSH`` postings, and so does each further step of routing.
    """
    frequent = np.array(sorted(slices), np.uint64)
    times_of = np.array([slices[w] for w in sorted(slices)] + [1], np.int64)
    shared = lines.sparkSession.sparkContext.broadcast((rank, wanted, asked))

    def send(batches):
        waiting, size = [], 0
        ranks, words_wanted, lines_asked = shared.value
        for batch in batches:
            if words_wanted is not None:
                batch = batch.filter(pa.array(with_word_in(batch, words_wanted)))
            words, first = sorted_lines(batch, ranks)
            sizes = np.diff(first)
            doc, number = batch["doc"].to_numpy(), batch["line"].to_numpy()
            hashes = batch["hash"].to_numpy().view(np.uint64)
            order = np.lexsort((number, doc, hashes))
            chosen = order[np.r_[True, hashes[order][1:] != hashes[order][:-1]]] if len(order) else order
            count = prefix_sizes(sizes[chosen], similarity)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            line = np.repeat(chosen, count)
            word = words[first[line] + place]
            marks, mark_start = signatures(words, first)
            token = mix(word)
            if words_wanted is not None:
                kept = in_map(words_wanted, token)
                word, token, line, place = word[kept], token[kept], line[kept], place[kept]
            at = np.searchsorted(frequent, word)
            known = np.flatnonzero(frequent[np.minimum(at, len(frequent) - 1)] == word) if len(frequent) else []
            many = np.ones(len(word), np.int64)
            many[known] = times_of[at[known]]
            key = line_hash(doc[line], number[line])
            at = (key % many.astype(np.uint64)).astype(np.int64)
            flags = np.where(many > 1, SLICED, 0)
            if lines_asked is not None:
                guest = np.flatnonzero((many > 1) & in_map(lines_asked, key))
                times = many[guest] - 1
                guest = np.repeat(guest, times)
                turn = np.arange(len(guest)) - np.repeat(np.cumsum(times) - times, times) + 1
                at = np.concatenate([at, (at[guest] + turn) % many[guest]])
                token, line, place = (np.concatenate([v, v[guest]]) for v in (token, line, place))
                flags = np.concatenate([flags, np.full(len(guest), SLICED | GUEST)])
            token = np.where(at > 0, mix(token + at.astype(np.uint64) * BASE), token)
            columns = {
                "tokens": token,
                "docs": doc[line],
                "lines": number[line],
                "sizes": sizes[line],
                "places": place,
                "checks": hashes[line] >> np.uint64(32),
                "flags": flags,
            }
            waiting.append((columns, marks[spread_out(mark_start, line)]))
            size += len(token)
            if size > FLUSH:
                yield posted(waiting, 1, levels)
                waiting, size = [], 0
        if size:
            yield posted(waiting, 1, levels)

    sent = lines.select("doc", "line", "hash", "words").mapInArrow(send, POSTINGS)
    for level in range(2, levels + 1):
        sent = sent.repartition("part").sortWithinPartitions("part").mapInArrow(route_postings(level, levels), POSTINGS)
    return sent


def posted(waiting: list, level: int, levels: int) -> pa.RecordBatch:
    """Postings by ranges of the word's hash, a row each; its last 32 bits go along in the end."""
    c = {n: np.concatenate([x[n] for x, _ in waiting]) for n in KINDS}
    marks = np.concatenate([m for _, m in waiting])
    order = np.argsort(c["tokens"])
    start = np.concatenate(([0], np.cumsum(widths(c["sizes"].astype(np.int64)))))
    c = {n: v[order] for n, v in c.items()}
    marks = marks[spread_out(start, order)]
    start = np.concatenate(([0], np.cumsum(widths(c["sizes"].astype(np.int64)))))
    bits = np.uint64(FAN_BITS * level)
    part = c["tokens"] >> (np.uint64(64) - bits)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]))
    c["tokens"] = c["tokens"] << bits
    kinds = KINDS | {"tokens": "<u8"}
    if level == levels:
        c["tokens"], kinds = c["tokens"] >> np.uint64(32), KINDS
    rows = {n: pa.array([planes(np.ascontiguousarray(c[n][a:b].astype(k))) for a, b in spans], pa.binary()) for n, k in kinds.items()}
    rows["part"] = pa.array(part[cuts].astype(np.int64))
    rows["marks"] = pa.array([marks[start[a] : start[b]].tobytes() for a, b in spans], pa.binary())
    names = [n.split()[0] for n in POSTINGS.split(", ")]
    return pa.RecordBatch.from_arrays([rows[n] for n in names], names)


def route_postings(level: int, levels: int):
    def deal(batches):
        part, waiting, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch["part"][i].as_py()
                if size and (number != part or size > FLUSH):
                    yield posted(waiting, level, levels)
                    waiting, size = [], 0
                part = number
                c = {n: from_planes(batch[n][i].as_py(), k) for n, k in (KINDS | {"tokens": "<u8"}).items()}
                done = np.uint64(FAN_BITS * (level - 1))
                c["tokens"] = (np.uint64(part) << (np.uint64(64) - done)) | (c["tokens"] >> done)
                waiting.append((c, np.frombuffer(batch["marks"][i].as_py(), np.uint64)))
                size += len(c["tokens"])
        if size:
            yield posted(waiting, level, levels)

    return deal


def spread_out(start: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of the chosen sets' signature words, one set after the other."""
    count = start[chosen + 1] - start[chosen]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start[chosen], count) + within


class Group(NamedTuple):
    """The postings of a range of words, by word, size, document and line."""

    c: dict[str, np.ndarray]
    folded: Folded
    last: np.ndarray  # behind the postings of the same word that can share it as first word


def group_of(table: pa.Table, similarity: tuple[int, int]) -> Group:
    num, den = similarity
    c = {n: np.concatenate([from_planes(x.as_py(), k) for x in table[n]]) for n, k in KINDS.items()}
    marks = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["marks"]])
    order = np.lexsort((c["lines"], c["docs"], c["sizes"], c["tokens"]))
    start = np.concatenate(([0], np.cumsum(widths(c["sizes"].astype(np.int64)))))
    folded = Folded(marks[spread_out(start, order)], c["sizes"][order].astype(np.int64))
    c = {n: v[order] for n, v in c.items()}
    token = c["tokens"].astype(np.uint64) << np.uint64(32)
    most = np.maximum(0, (den * c["sizes"].astype(np.int64) - (num + den) * c["places"].astype(np.int64)) // num)
    return Group(c, folded, np.searchsorted(token | c["sizes"], token | most.astype(np.uint64), "right"))


def passing_pairs(group: Group, similarity: tuple[int, int], asked: np.ndarray | None = None):
    """Batches of (later, earlier, excess): pairs of a word's postings that pass all filters.

    The filters are bounds that no similar pair fails at the first word that it shares,
    where all that it shares is still to come: sizes, the places of the word, and the
    bits in which the signatures differ. Equal sets are left to the exact step. A guest
    is only ever the later one. With ``asked`` only pairs whose later line is marked
    there are tried.
    """
    num, den = similarity
    c = group.c
    size, place = c["sizes"].astype(np.int64), c["places"].astype(np.int64)
    doc, line = c["docs"], c["lines"]
    guest = c["flags"] & GUEST > 0
    step = 1
    left = np.flatnonzero(group.last > np.arange(len(size)) + step)
    while len(left):
        steps = max(1, PAIRS // len(left))
        count = np.minimum(group.last[left] - left - step, steps)
        i = np.repeat(left, count)
        j = i + step + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        a, b = size[i], size[j]
        need = -(-num * (a + b) // (num + den))
        good = np.minimum(a - place[i], b - place[j]) >= need
        i, j, need = i[good], j[good], need[good]
        first = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j]))
        y, x = np.where(first, j, i), np.where(first, i, j)
        good = ((doc[i] != doc[j]) | (line[i] != line[j])) & ~guest[x]
        if asked is not None:
            good &= asked[y]
        y, x, need = y[good], x[good], need[good]
        differ = group.folded.differ(y, x)
        excess = differ - (size[y] + size[x] - 2 * need)
        equal = (differ == 0) & (size[y] == size[x]) & (c["checks"][y] == c["checks"][x])
        good = (excess <= 0) & ~equal
        if good.any():
            yield y[good], x[good], excess[good]
        step += steps
        left = left[group.last[left] > left + step]


def candidates_of(table: pa.Table, similarity: tuple[int, int]) -> pa.Table:
    """For every line at a rare word the earlier line there whose signature is nearest.

    ``more`` says that others pass as well. A line in a slice of a word has ``sliced`` in
    any case, for the other slices, and a row without another line if none passes.
    """
    group = group_of(table, similarity)
    c, count = group.c, len(group.last)
    hits, nearest = np.zeros(count, np.int64), np.full(count, -1)
    distance = np.full(count, np.iinfo(np.int64).max)
    for y, x, excess in passing_pairs(group, similarity):
        order = np.lexsort((excess, y))  # a line can be in a batch many times
        y, x, excess = y[order], x[order], excess[order]
        np.add.at(hits, y, 1)
        best = np.r_[True, y[1:] != y[:-1]]
        y, x, excess = y[best], x[best], excess[best]
        nearer = excess < distance[y]
        distance[y[nearer]], nearest[y[nearer]] = excess[nearer], x[nearer]
    sliced = c["flags"] & SLICED > 0
    y = np.flatnonzero((nearest >= 0) | sliced)
    x = nearest[y]
    return pa.table(
        {
            "doc": pa.array(c["docs"][y]),
            "line": pa.array(c["lines"][y].astype(np.int64)),
            "other_doc": pa.array(c["docs"][x], mask=x < 0),
            "other_line": pa.array(c["lines"][x].astype(np.int64), mask=x < 0),
            "more": pa.array((hits[y] > 1) & ~sliced[y]),
            "sliced": pa.array(sliced[y]),
        }
    )


def involved(table: pa.Table, similarity: tuple[int, int], asked: bytes) -> pa.Table:
    """The postings in a pair whose later line is asked for and passes: at most one row each."""
    group = group_of(table, similarity)
    c = group.c
    wanted = in_map(asked, line_hash(c["docs"], c["lines"].astype(np.int64)))
    later, some = np.zeros(len(wanted), bool), np.zeros(len(wanted), bool)
    for y, x, _ in passing_pairs(group, similarity, wanted):
        later[y] = some[y] = some[x] = True
    at = np.flatnonzero(some)
    part = np.full(len(at), table["part"][0].as_py() if len(at) else 0)
    return pa.table(
        {
            "part": pa.array(part),
            "token": pa.array(c["tokens"][at].astype(np.int64)),
            "doc": pa.array(c["docs"][at]),
            "line": pa.array(c["lines"][at].astype(np.int64)),
            "later": pa.array(later[at]),
            "guest": pa.array(c["flags"][at] & GUEST > 0),
        }
    )


INVOLVED = "part bigint, token bigint, doc bigint, line bigint, later boolean, guest boolean"


def line_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def marked_texts(marks, hit: bool):
    """The rows whose hash is in the map, or those whose hash is not."""

    def choose(batches):
        for batch in batches:
            kept = in_map(marks.value, batch["h"].to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(kept if hit else ~kept))

    return choose


def texts_with(keyed: DataFrame, of_doc: DataFrame) -> DataFrame:
    """``keyed`` with ``gone``, the lines that its text loses."""
    return keyed.join(of_doc, ["doc", "ver"], "left")


def key_of(docs: DataFrame):
    """Ids as longs with a stand-in for null, as in the arrays of the tasks."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))


def words_table(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc``, ``line``, ``hash``, ``words`` of the given lines; the others stay out of the shuffle."""
    marks = lines.sparkSession.sparkContext.broadcast(line_map(wanted))

    def likely(batches):
        for batch in batches:
            kept = in_map(marks.value, line_hash(batch["doc"].to_numpy(), batch["line"].to_numpy()))
            yield batch.filter(pa.array(kept))

    some = lines.select("doc", "line", "hash", "words").mapInArrow(likely, "doc bigint, line bigint, hash bigint, words binary")
    return materialize(some.join(wanted, ["doc", "line"], "left_semi").dropDuplicates(["doc", "line", "hash"]), "words")


def overlaps(batch: pa.RecordBatch) -> np.ndarray:
    """How many words the sets ``words`` and ``theirs`` of each row share."""
    out = np.zeros(batch.num_rows, np.int64)
    for at in range(0, batch.num_rows, 2048):
        sides = []
        for name in ("words", "theirs"):
            words, first = unpacked(batch.slice(at, 2048)[name])
            sides.append((np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first)) << np.uint64(8 * WORD_BYTES)) | words)
        both = np.sort(np.concatenate(sides))
        same = both[1:][both[1:] == both[:-1]] >> np.uint64(8 * WORD_BYTES)
        out[at : at + 2048] = np.bincount(same.astype(np.int64), minlength=len(out[at : at + 2048]))
    return out


def similar_pairs(similarity: tuple[int, int]):
    num, den = similarity

    def judge(batches):
        for batch in batches:
            shared = overlaps(batch)
            sizes = sum(np.diff(unpacked(batch[n])[1]) for n in ("words", "theirs"))
            good = pa.array(den * shared >= num * (sizes - shared))
            yield batch.select(["doc", "line", "hash"]).filter(good)

    return judge


def verified(lines: DataFrame, candidates: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``doc``, ``line``, ``hash`` of the candidate lines that are similar, by exact Jaccard.

    A pair is a row, one for each of a line's rare words at most; the words of an
    earlier line that very many point at are broadcast.
    """
    pairs = candidates.where("other_doc is not null").select("doc", "line", "other_doc", "other_line").distinct()
    pairs = materialize(pairs, "pairs")
    other = pairs.select(F.col("other_doc").alias("doc"), F.col("other_line").alias("line"))
    words = words_table(lines, pairs.select("doc", "line").unionByName(other).distinct())
    theirs = words.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("words").alias("theirs"))
    both = lookup(pairs, theirs, ["other_doc", "other_line"]).join(words, ["doc", "line"])
    both = both.select("doc", "line", "hash", "words", "theirs")
    return both.mapInArrow(similar_pairs(similarity), "doc bigint, line bigint, hash bigint").distinct()


def similar_lines(table: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``doc``, ``line``, ``hash`` of the lines with a similar, not equal, earlier line.

    The first round tries one candidate of a line at each of its rare words. Lines whose
    candidates all fail and that have more are then compared with all the others
    inside their words' groups, those that have more in other slices only inside the
    sliced words' groups: only the lines in pairs that pass the filters are sent there
    with their words, once per word, whatever the number of pairs.
    """
    lines = table.where("doc is not null")
    rank, slices, words = word_ranks(table)
    levels = 1
    while words > PART_WORDS << (FAN_BITS * levels):
        levels += 1
    posted = postings(lines, rank, slices, levels, similarity, None, None)
    rows = posted.groupBy("part").applyInArrow(lambda group: candidates_of(group, similarity), CANDIDATES)
    rows = materialize(rows, "candidates")
    similar = materialize(verified(lines, rows, similarity), "similar")
    again = rows.where("more or sliced").groupBy("doc", "line").agg(F.bool_or("more").alias("more"))
    again = materialize(again.join(similar, ["doc", "line"], "left_anti"), "again")
    if again.isEmpty():
        return similar
    marks = line_map(again)
    asked = lines.sparkSession.sparkContext.broadcast(marks)
    rare = rare_words(lines, marks, line_map(again.where("more")), rank, slices, similarity)
    posted = postings(lines, rank, slices, levels, similarity, rare, marks)
    some = posted.groupBy("part").applyInArrow(lambda group: involved(group, similarity, asked.value), INVOLVED)
    some = materialize(some, "involved")
    found = words_table(lines, some.select("doc", "line").distinct())
    together = some.join(found, ["doc", "line"]).repartition("part", "token")
    together = together.sortWithinPartitions("part", "token", "guest", "doc", "line")
    columns = "part bigint, token bigint, doc bigint, line bigint, later boolean, guest boolean, hash bigint, words binary"
    together = together.select(*[c.split()[0] for c in columns.split(", ")])
    rest = together.mapInArrow(matched_in_groups(similarity), "doc bigint, line bigint, hash bigint")
    return similar.unionByName(rest).distinct()


class Residents:
    """The lines of one word so far, to find one that is similar to another line."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []
        self.sizes: list[int] = []
        self.words: list[np.ndarray] = []
        self.index = None

    def add(self, key: tuple[int, int], words: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(words))
        self.words.append(words)
        self.index = None

    def has_similar(self, key: tuple[int, int], words: np.ndarray, similarity: tuple[int, int]) -> bool:
        num, den = similarity
        if not self.keys:
            return False
        if self.index is None:
            every = np.concatenate(self.words)
            owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
            order = np.argsort(every, kind="stable")
            self.index = every[order], owner[order], np.array(self.sizes), np.array(self.keys)
        every, owner, sizes, keys = self.index
        a, b = np.searchsorted(every, words), np.searchsorted(every, words, "right")
        count = b - a
        hits = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        shared = np.bincount(owner[hits], minlength=len(sizes))
        good = den * shared >= num * (sizes + len(words) - shared)
        earlier = (keys[:, 0] < key[0]) | ((keys[:, 0] == key[0]) & (keys[:, 1] < key[1]))
        return bool((good & earlier).any())


def matched_in_groups(similarity: tuple[int, int]):
    """Of rows by word, residents before guests, the later lines with a similar earlier one."""

    def match(batches):
        at, residents, waiting = None, Residents(), []

        def judge():
            hit = [r for r in waiting if residents.has_similar((r[0], r[1]), r[3], similarity)]
            columns = [pa.array([r[i] for r in hit], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["doc", "line", "hash"])

        for batch in batches:
            words, first = unpacked(batch["words"])
            columns = [batch[c].to_pylist() for c in ("part", "token", "doc", "line", "later", "guest", "hash")]
            for i, (part, token, doc, line, later, guest, hash_) in enumerate(zip(*columns)):
                if (part, token) != at or len(waiting) > SLICE_LINES:
                    yield judge()
                    waiting = []
                    if (part, token) != at:
                        at, residents = (part, token), Residents()
                mine = words[first[i] : first[i + 1]]
                if later:
                    waiting.append((doc, line, hash_, mine))
                if not guest:
                    residents.add((doc, line), mine)
        yield judge()

    return match


def rare_words(
    lines: DataFrame, asked: bytes, whole: bytes, rank: np.ndarray, slices: dict[int, int], similarity: tuple[int, int]
) -> bytes:
    """A map of the prefix words of the lines asked for, sliced ones only if a line is not in ``whole``."""
    frequent = np.array(sorted(slices), np.uint64)
    shared = lines.sparkSession.sparkContext.broadcast((rank, asked, whole))

    def take(batches):
        for batch in batches:
            ranks, marks, all_words = shared.value
            mine = batch.filter(pa.array(in_map(marks, line_hash(batch["doc"].to_numpy(), batch["line"].to_numpy()))))
            words, first = sorted_lines(mine, ranks)
            count = prefix_sizes(np.diff(first), similarity)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            word = words[np.repeat(first[:-1], count) + place]
            every = in_map(all_words, line_hash(mine["doc"].to_numpy(), mine["line"].to_numpy()))
            word = word[np.repeat(every, count) | np.isin(word, frequent)]
            yield pa.RecordBatch.from_pydict({"h": pa.array(mix(word).view(np.int64))})

    return hash_map(lines.select("doc", "line", "words").mapInArrow(take, "h bigint"), "h")


def line_map(lines: DataFrame) -> bytes:
    def hashes(batches):
        for batch in batches:
            h = line_hash(batch["doc"].to_numpy(), batch["line"].to_numpy())
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64))})

    return hash_map(lines.mapInArrow(hashes, "h bigint"), "h")


def removed_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc``, ``ver``, ``line`` of every line that matches an earlier one."""
    table = line_table(docs)
    lines = table.where("doc is not null").select("doc", "line", "ver", "hash")
    first = F.min(F.struct("doc", "line")).alias("first")
    repeated = lines.groupBy("hash").agg(first, F.count(F.lit(1)).alias("times")).where("times > 1").select("hash", "first")
    repeated = materialize(repeated, "repeated")
    equal = lookup(lines, repeated, ["hash"]).where(F.struct("doc", "line") > F.col("first"))
    similar = lines.join(similar_lines(table, similarity), ["doc", "line", "hash"], "left_semi")
    return equal.select("doc", "ver", "line").unionByName(similar.select("doc", "ver", "line")).distinct()


def dedup_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id``, ``kept`` (text), ``n_lines``, ``n_removed``, ``rest`` for every row of ``docs``.

    A line goes if an earlier line, of a smaller id or higher up in the same text,
    has a Jaccard similarity of at least ``similarity`` to it, as sets of lower-case
    words (runs of letters and digits). This is judged on the input, not on what is
    left. Lines without words stay. A null text has no lines and stays null; a null
    id comes before all others. Rows that share an id are versions of one document:
    lines of theirs with the same number are not earlier or later than each other.
    The other columns of ``docs`` come along as the struct ``rest``.
    """
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(True).alias("none")]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("rest"))
    gone = materialize(removed_lines(rows.select("doc_id", "text"), similarity), "removed")
    of_doc = gone.groupBy("doc", "ver").agg(F.collect_list("line").alias("gone"))
    kind = dict(rows.dtypes)["doc_id"]
    rest = rows.schema["rest"].dataType.simpleString()
    out = f"doc_id {kind}, kept string, n_lines bigint, n_removed bigint, rest {rest}"

    def cut(batches):
        for batch in small_batches(batches):
            texts = batch["text"].to_pylist()
            gone = batch["gone"].to_pylist() if "gone" in batch.schema.names else [None] * len(texts)
            lines = [t.split("\n") if t is not None else [] for t in texts]
            drop = [set(g or ()) for g in gone]
            kept = [
                None if t is None else t if not d else "\n".join([x for i, x in enumerate(ls) if i not in d])
                for t, ls, d in zip(texts, lines, drop)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "kept": pa.array(kept, pa.string()),
                    "n_lines": pa.array([len(x) for x in lines], pa.int64()),
                    "n_removed": pa.array([len(d) for d in drop], pa.int64()),
                    "rest": batch["rest"],
                }
            )

    marks = rows.sparkSession.sparkContext.broadcast(hash_map(of_doc.select(F.xxhash64("doc", "ver").alias("h")), "h"))
    keyed = rows.withColumns({"doc": key_of(rows), "ver": F.xxhash64("text")}).withColumn("h", F.xxhash64("doc", "ver"))
    clean = keyed.mapInArrow(lambda batches: cut(marked_texts(marks, False)(batches)), out)
    touched = texts_with(keyed.mapInArrow(marked_texts(marks, True), keyed.schema), of_doc)
    return clean.unionByName(touched.select("doc_id", "text", "rest", "gone").mapInArrow(cut, out))


def op10_lines(spark, sf_dir):
    """Lines removed from every document and the digest of what is kept."""
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
