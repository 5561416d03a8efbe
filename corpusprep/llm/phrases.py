"""Collocations: frequent phrases found by mergeable Misra-Gries summaries, then counted exactly."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import documents, from_planes, lookup, mix, planes, small_batches, texts_of, words_of
from corpusprep.sources.scratch import materialize

PHRASE_WORDS = 3
THRESHOLD = 10
TOP = 2000
COVERED = 50  # per cent of a phrase's occurrences that lie inside a longer one
FAN_BITS = 6  # a step of routing deals over 64 ranges of the hash
PART_MASS = 1 << 25  # occurrences that a summary is meant for
FLUSH = 6_000_000  # occurrences that a task combines before it sends them
MAP_BITS = 27  # of the map of surviving hashes: 16 MB for any input
SALTS = 64

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[0x09] = 0x20
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[0x0A:0x0E] = True
SEPARATOR = BREAK.copy()
SEPARATOR[0x20] = True
STEP = np.uint64(0xD1342543DE82EF95)
MESSAGES = "part bigint, blob boolean, mass bigint, tokens binary, counts binary"


class Grams(NamedTuple):
    """Every phrase of up to ``PHRASE_WORDS`` words in a batch: hash, bytes and text."""

    data: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    words: np.ndarray  # of each text


def grams_of(column, languages: np.ndarray, longest: int) -> Grams:
    """Words are joined by one space in ``data``; ``languages`` holds a hash for each text."""
    data, bounds = texts_of(column)
    data = FOLD[data]
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    data = data[kept]
    found = words_of(data, bounds, SEPARATOR)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(found.first))
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), found.starts) + row
    key = mix(found.hashes ^ languages[row])
    keys, starts, ends, rows = [key], [found.starts], [found.ends], [row]
    rolled = key
    for n in range(2, longest + 1):
        rolled = rolled[:-1] * STEP + key[n - 1 :]
        inside = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1])
        keys.append(mix(rolled[inside] + np.uint64(n)))
        starts.append(found.starts[inside])
        ends.append(found.ends[inside + n - 1])
        rows.append(row[inside])
    return Grams(data, *map(np.concatenate, (keys, starts, ends, rows)), np.diff(found.first))


def language_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return batch["lang_hash"].to_numpy(zero_copy_only=False).view(np.uint64)


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, ascending, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def messages(keys: np.ndarray, counts: np.ndarray, level: int, last: bool) -> pa.RecordBatch:
    """Ascending keys dealt by their first bits: for each range its mass, then its counts.

    The last step of routing keeps 32 bits behind those of the range. Hashes that fall
    together there share a counter, which can only add survivors.
    """
    bits = np.uint64(FAN_BITS * level)
    part = keys >> (np.uint64(64) - bits)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    rest = keys << bits
    rest = (rest >> np.uint64(32)).astype("<u4") if last else rest
    slices = [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(keys)))]
    parts = part[cuts].astype(np.int64)
    none = [None] * len(slices)
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(np.concatenate([parts, parts])),
            "blob": pa.array([False] * len(slices) + [True] * len(slices)),
            "mass": pa.array([int(counts[s].sum()) for s in slices] + none, pa.int64()),
            "tokens": pa.array(none + [planes(np.ascontiguousarray(rest[s])) for s in slices], pa.binary()),
            "counts": pa.array(none + [planes(counts[s].astype("<u4")) for s in slices], pa.binary()),
        }
    )


class Summary:
    """Misra-Gries counters: a key's count is at most ``lost`` above its counter.

    Summaries are merged by adding counters. If more than ``capacity`` are left, the
    next largest counter is taken from all. That happens at most mass / (capacity + 1)
    times in units, whatever the order of merges, so with a capacity above mass /
    threshold every key of at least ``threshold`` occurrences keeps a counter.
    """

    def __init__(self, capacity: int, kind: str) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, kind), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > self.capacity:
            self.merge()

    def merge(self) -> None:
        keys, counts = zip((self.keys, self.counts), *self.waiting)
        self.keys, self.counts = combined(np.concatenate(keys), np.concatenate(counts))
        self.waiting, self.size = [], 0
        over = len(self.counts) - self.capacity
        if over > 0:
            taken = int(np.partition(self.counts, over - 1)[over - 1])
            left = self.counts > taken
            self.keys, self.counts = self.keys[left], self.counts[left] - taken
            self.lost += taken

    def possible(self, threshold: int) -> np.ndarray:
        """The keys that may have ``threshold`` occurrences."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def levels_of(size: int, part_mass: int = PART_MASS) -> int:
    """Steps of routing until a range has about ``part_mass`` occurrences of ``size`` bytes of text."""
    levels = 1
    while size // 2 > part_mass << (FAN_BITS * levels):
        levels += 1
    return levels


def survivors(texts: DataFrame, longest: int, threshold: int, levels: int) -> bytes:
    """A bit for the first ``MAP_BITS`` bits of the hash of every phrase that may be frequent.

    Tasks combine the occurrences they read and send them by ranges of the hash. Each
    step of routing makes 64 rows of a task's buffer, so rows grow with the input, not
    with its square. The masses of a range come first and give its summary's capacity.
    """

    def send(batches):
        waiting, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return messages(keys, counts, 1, levels == 1)

        for batch in small_batches(batches):
            waiting.append(grams_of(batch["text"], language_hashes(batch), longest).keys)
            size += len(waiting[-1])
            if size > FLUSH:
                yield flush()
                waiting, size = [], 0
        if size:
            yield flush()

    def route(level: int):
        def deal(batches):
            part, waiting, size = None, [], 0
            for row in rows_of(batches, "<u8"):
                if row.part != part or size > FLUSH:
                    if size:
                        yield messages(*combined(*map(np.concatenate, zip(*waiting))), level, level == levels)
                    part, waiting, size = row.part, [], 0
                if row.tokens is not None:
                    done = np.uint64(FAN_BITS * (level - 1))
                    waiting.append(((np.uint64(part) << (np.uint64(64) - done)) | (row.tokens >> done), row.counts))
                    size += len(row.tokens)
            if size:
                yield messages(*combined(*map(np.concatenate, zip(*waiting))), level, level == levels)

        return deal

    def found(part: int, summary: Summary) -> pa.RecordBatch:
        bits = np.zeros(max(8, 1 << (MAP_BITS - FAN_BITS * levels)), np.uint8)
        bits[summary.possible(threshold) >> np.uint32(32 - int(np.log2(len(bits))))] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_pydict({"part": pa.array([part]), "bits": pa.array([packed], pa.binary())})

    def merge(batches):
        part, mass, summary = None, 0, None
        for row in rows_of(batches, "<u4"):
            if row.part != part:
                if summary:
                    yield found(part, summary)
                part, mass, summary = row.part, 0, None
            if row.tokens is None:
                mass += row.mass
                continue
            summary = summary or Summary(mass // threshold + 1, "<u4")
            summary.add(row.tokens, row.counts)
        if summary:
            yield found(part, summary)

    sent = texts.mapInArrow(send, MESSAGES)
    for level in range(2, levels + 1):
        sent = in_parts(sent).mapInArrow(route(level), MESSAGES)
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = max(1, 1 << (MAP_BITS - FAN_BITS * levels - 3))
    for row in in_parts(sent).mapInArrow(merge, "part bigint, bits binary").collect():
        out[row.part * width : (row.part + 1) * width] |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def in_parts(sent: DataFrame) -> DataFrame:
    """Messages of a range together, the masses first."""
    return sent.repartition("part").sortWithinPartitions("part", "blob")


class Message(NamedTuple):
    part: int
    mass: int | None
    tokens: np.ndarray | None
    counts: np.ndarray | None


def rows_of(batches, kind: str):
    for batch in batches:
        columns = [batch[c] for c in ("part", "mass", "tokens", "counts")]
        for part, mass, tokens, counts in zip(*columns):
            if tokens.is_valid:
                blobs = from_planes(tokens.as_py(), kind), from_planes(counts.as_py(), "<u4").astype(np.int64)
                yield Message(part.as_py(), None, *blobs)
            else:
                yield Message(part.as_py(), mass.as_py(), None, None)


def phrase_counts(texts: DataFrame, bits: bytes, longest: int, threshold: int) -> DataFrame:
    """``lang``, ``phrase``, ``a``: exact counts of all frequent phrases, one word long or more.

    The phrase null has the number of all words of a language. All occurrences of a
    phrase whose bit is set are counted, so other phrases with that bit do no harm.
    """
    marks = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        known = np.frombuffer(marks.value, np.uint8)
        for batch in small_batches(batches):
            found = grams_of(batch["text"], language_hashes(batch), longest)
            at = found.keys >> np.uint64(64 - MAP_BITS)
            hit = np.flatnonzero((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            _, first, counts = np.unique(found.keys[hit], return_index=True, return_counts=True)
            first = hit[first]
            total = pa.nulls(len(found.words), pa.string())
            phrases = slices(found.data, found.starts[first], found.ends[first])
            for language, phrase, n in (
                (batch["lang"].take(pa.array(found.rows[first])), phrases, counts),
                (batch["lang"], total, found.words),
            ):
                yield pa.RecordBatch.from_arrays([language, phrase, pa.array(n.astype(np.int64))], ["lang", "phrase", "a"])

    rows = texts.mapInArrow(count, "lang string, phrase string, a bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("phrase").isNull() | (F.col("a") >= threshold))


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between byte positions."""
    length = ends - starts
    bounds = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], length)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[at]))


def collocations(
    docs: DataFrame, longest: int = PHRASE_WORDS, threshold: int = THRESHOLD, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    Words are runs without blanks inside pieces that ``.,;:!?`` and line ends cut, with A
    to Z in lower case. A phrase of 2 to ``longest`` words with ``a >= threshold``
    occurrences scores floor(10**6 a a / (l r)) at its worst cut into parts of l and r
    occurrences, the first of equal ones. It goes if a longer one that holds it has
    ``covered`` per cent of its occurrences. Equal ranks cannot be: ties go by ``a``, then
    by the bytes of the phrase. A null text has no words, a null language is ``und``.
    Repeated rows count each time. Fewer than two frequent words give no rows.

    The first pass over the texts finds all phrases that may be frequent (``survivors``),
    the second counts those exactly. The parts of a frequent phrase are frequent
    themselves, so all counts come from one table.
    """
    language = F.coalesce(F.col("lang"), F.lit("und"))
    texts = docs.select("text", language.alias("lang"), F.xxhash64(language).alias("lang_hash"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = survivors(texts, longest, threshold, levels_of(size))
    counts = materialize(phrase_counts(texts, bits, longest, threshold), "phrases")
    known = counts.where("phrase is not null")
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    phrases = known.where(F.size(words) > 1)
    cuts = phrases.select("lang", "phrase", "a", cut).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        part = known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = lookup(materialize(cuts, "cuts"), part, ["lang", side])
    exact = "cast({} as decimal(14,0))"
    a, l, r = (exact.format(c) for c in "alr")
    scored = cuts.withColumn("score", F.expr(f"cast(1000000 as decimal(7,0)) * ({a} * {a}) div ({l} * {r})"))
    worst = F.min(F.struct("score", "k", "a", "l", "r")).alias("worst")
    scored = scored.groupBy("lang", "phrase").agg(worst).select("lang", "phrase", "worst.a", "worst.l", "worst.r", "worst.score")
    return best(scored.join(covered_phrases(phrases, covered), ["lang", "phrase"], "left_anti"), counts, top)


def covered_phrases(phrases: DataFrame, covered: int) -> DataFrame:
    """The phrases that lie inside longer ones for ``covered`` per cent of their occurrences."""
    words = F.split("phrase", " ")
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size(words) - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
            ),
        )
    )
    longer = phrases.where(F.size(words) > 2).select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("most"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    held = phrases.select("lang", "phrase", "a").join(longer, ["lang", "phrase"])
    return held.where(F.col("most") * 100 >= F.col("a") * covered).select("lang", "phrase")


def best(scored: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; the last window sees ``top`` rows of each of ``SALTS`` shares."""
    order = "ORDER BY score DESC, a DESC, phrase"
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("rank") <= top)
    ranked = some.drop("salt").withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("bigint"))
    total = counts.where("phrase is null").select("lang", F.col("a").alias("n"))
    return ranked.where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir):
    """The best phrases of every language in ``documents``."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH words AS (
    SELECT lang, doc_id, piece, unnest(w) AS word, unnest(range(len(w))) AS place
    FROM (
        SELECT lang, doc_id, piece, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w
        FROM (
            SELECT lang, doc_id, unnest(p) AS t, unnest(range(len(p))) AS piece
            FROM (
                SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc_id, string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]') AS p
                FROM documents
            )
        )
    )
), next AS (
    SELECT lang, word AS w1, lead(word, 1) OVER following AS w2, lead(word, 2) OVER following AS w3
    FROM words WINDOW following AS (PARTITION BY doc_id, piece ORDER BY place)
), f AS MATERIALIZED (
    SELECT lang, phrase, size, count(*) AS a
    FROM (
        SELECT lang, w1 AS phrase, 1 AS size FROM next
        UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM next WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM next WHERE w3 IS NOT NULL
    )
    GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
    SELECT lang, phrase, size, a, k,
        array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
        array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)
), scored AS (
    SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r,
        (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts AS c
    JOIN f AS x ON x.lang = c.lang AND x.phrase = c.head
    JOIN f AS y ON y.lang = c.lang AND y.phrase = c.tail
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, phrase, max(a) AS most
    FROM (
        SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase
        FROM (SELECT *, unnest([1, 2]) AS i FROM f WHERE size = 3)
    )
    GROUP BY ALL
), kept AS (
    SELECT s.* FROM scored AS s LEFT JOIN inside AS i USING (lang, phrase)
    WHERE i.most IS NULL OR 100 * i.most < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang)
QUALIFY rank <= 2000
"""
