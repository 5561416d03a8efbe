"""Learning a byte-level BPE vocabulary from distributed word counts.

The word table never leaves the executors. Each round counts neighbouring
symbols over all words, reduces the words to the short runs in which the next
merges must happen, and rewrites the table with the merges found. The result
equals merging the most frequent pair again and again.
"""

from __future__ import annotations

import logging
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.config import EOS
from corpusprep.functions.arrow import small_arrays
from corpusprep.functions.bytelevel import (
    BYTE_OF_ID,
    EOS_ID,
    MAX_TOKENS,
    WORD_BREAK,
    byte_symbols,
    ids_of,
    symbol,
    symbol_id,
    symbol_ids,
    token_id,
)
from corpusprep.functions.normalize import nfkc
from corpusprep.functions.pretokenize import words
from corpusprep.sources.scratch import drop_scratch, write_scratch

# Bounds on what the driver receives per round. None of them changes the result.
FIRST_HOT_PAIRS = 64
MAX_HOT_PAIRS = 2048
MAX_RUNS = 100_000

# Up to this many merges strings are rewritten by JVM functions, one pass per
# merge; above it, words are looked up in a per-task cache.
NATIVE_MERGES = 32
CACHED_WORDS = 50_000
LONG_WORD = 256


LOG = logging.getLogger(__name__)


class Merge(NamedTuple):
    left_id: int
    right_id: int
    new_id: int
    freq: int


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary: its size is bounded by the configured ``vocab_size``."""

    merges: tuple[Merge, ...] = ()
    eos: str = EOS

    def token_bytes(self) -> list[bytes]:
        """Bytes of every token by id; the end-of-story marker is its own text."""
        tokens = [self.eos.encode()] + [bytes([BYTE_OF_ID[i]]) for i in sorted(BYTE_OF_ID)]
        for m in self.merges:
            if m.new_id == len(tokens):
                tokens.append(tokens[m.left_id] + tokens[m.right_id])
        return tokens

    def reuses_tokens(self) -> bool:
        """Whether some merge produced a token that was already there."""
        return len({m.new_id for m in self.merges}) < len(self.merges)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Frequency of every word over all texts; counted before the shuffle."""
    return (
        texts.select(F.explode(words(nfkc(F.col(text)))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def symbol_words(counts: DataFrame) -> DataFrame:
    return counts.select(byte_symbols(F.col("word")).alias("symbols"), "freq")


def apply_merges(symbols: Column, merges: Sequence[Merge], reused: bool = False) -> Column:
    """Join the merges' pairs in strings of symbols, words apart by word breaks.

    The merge listed first goes first wherever several apply. ``reused`` says
    that merges may give tokens that earlier merges use.
    """
    if not merges:
        return symbols
    if len(merges) > NATIVE_MERGES or reused:
        return merge_words(merges, reused)(symbols)
    steps = F.lit([symbol(m.left_id) + symbol(m.right_id) + symbol(m.new_id) for m in merges])
    return F.aggregate(
        steps,
        symbols,
        lambda s, step: F.replace(s, F.substring(step, 1, 2), F.substring(step, 3, 1)),
    )


def token_ids(symbols: Column, merges: Sequence[Merge], reused: bool = False) -> Column:
    """``apply_merges`` and then the ids of the tokens, in one pass through Python."""
    if len(merges) > NATIVE_MERGES or reused:
        return merge_words(merges, reused, as_ids=True)(symbols)
    return symbol_ids(apply_merges(symbols, merges))


def merge_words(merges: Sequence[Merge], reused: bool, as_ids: bool = False):
    """UDF on strings of symbols that merges the words that a task repeats once.

    Its closure holds the merges, whose number ``vocab_size`` bounds. A full cache
    makes way for a new one, which takes over the words that come up again.
    Nothing is sent between tasks.
    """
    pairs = [symbol(m.left_id) + symbol(m.right_id) for m in merges]
    joined = [symbol(m.new_id) for m in merges]
    rank = {pair: i for i, pair in enumerate(pairs)}
    unknown = len(rank)
    # A reused token can bring back an earlier pair, so places then go one by one.
    longest = float("inf") if reused else LONG_WORD
    word_break, limit = WORD_BREAK, CACHED_WORDS

    @F.arrow_udf("array<bigint>" if as_ids else "string")
    def merged_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, str] = {}
        earlier: dict[str, str] = {}

        def ranks_of(word: str) -> list[int]:
            return [rank.get(a + b, unknown) for a, b in zip(word, word[1:])]

        def merge_long(word: str) -> str:
            while (first := min(ranks_of(word), default=unknown)) != unknown:
                word = word.replace(pairs[first], joined[first])
            return word

        def merge_short(word: str) -> str:
            parts, ranks = list(word), ranks_of(word)
            while (first := min(ranks, default=unknown)) != unknown:
                at = ranks.index(first)
                new = joined[first]
                parts[at : at + 2] = [new]
                del ranks[at]
                if at > 0:
                    ranks[at - 1] = rank.get(parts[at - 1] + new, unknown)
                if at < len(ranks):
                    ranks[at] = rank.get(new + parts[at + 1], unknown)
            return "".join(parts)

        def merge(word: str) -> str:
            nonlocal cache, earlier
            merged = earlier.get(word)
            if merged is None:
                merged = merge_long(word) if len(word) > longest else merge_short(word)
            if len(word) > LONG_WORD:
                return merged  # so that the number of cached words bounds their bytes
            if len(cache) >= limit:
                cache, earlier = {}, cache
            cache[word] = merged
            return merged

        for batch in small_arrays(batches):
            # Python sees each distinct word of a slice once; the rest is Arrow's work.
            lists = pc.split_pattern(batch, word_break)
            found = pc.list_flatten(lists).dictionary_encode()
            merged = [cache.get(w) or merge(w) for w in found.dictionary.to_pylist()]
            flat = pa.array(merged, pa.string()).take(found.indices)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            whole = pc.binary_join(pa.ListArray.from_arrays(offsets, flat), word_break)
            whole = pc.if_else(pc.is_valid(batch), whole, pa.scalar(None, pa.string()))
            yield ids_of(whole) if as_ids else whole

    return merged_words


def symbol_pairs(table: DataFrame) -> DataFrame:
    """``(pair, freq)`` of all neighbouring symbols."""
    pairs = F.regexp_extract_all("symbols", F.lit(r"(?s)(?=(..))"), F.lit(1))
    return (
        table.select(F.explode(pairs).alias("pair"), "freq")
        .groupBy("pair")
        .agg(F.sum("freq").alias("freq"))
    )


def pair_counts(table: DataFrame) -> DataFrame:
    """``(left_id, right_id, freq)`` of all neighbouring symbols."""

    def id_at(place: int) -> Column:
        return symbol_id(F.substring("pair", place, 1))

    return symbol_pairs(table).select(
        id_at(1).alias("left_id"), id_at(2).alias("right_id"), "freq"
    )


def regex_char(sym: str) -> str:
    return rf"\x{{{ord(sym):x}}}"


def hot_runs(table: DataFrame, hot: list[str]) -> DataFrame:
    """``(run, freq)``: the words cut wherever two neighbours are no hot pair."""
    rights: dict[str, str] = {}
    for left, right in (map(regex_char, pair) for pair in hot):
        rights[left] = rights.get(left, "") + right
    any_hot = "|".join(f"{left}[{right}]" for left, right in rights.items())
    runs = F.regexp_extract_all("symbols", F.lit(f"(?s)(?:(?={any_hot}).)+."), F.lit(0))
    return (
        table.select(F.explode(runs).alias("run"), "freq")
        .groupBy("run")
        .agg(F.sum("freq").alias("freq"))
    )


def merge_runs(
    runs: list[tuple[str, int]],
    bound: tuple[int, str],
    tokens: dict[bytes, int],
    names: list[bytes],
    room: int,
) -> list[Merge]:
    """Merge pairs of the runs in order, as long as they come before ``bound``.

    Pairs are ordered by ``(-freq, pair)``. ``tokens`` and ``names`` are extended
    by at most ``room`` new tokens. A merge that gives a token there was before
    ends the list, since that token also stands outside the runs.
    """
    texts = [run for run, _ in runs]
    weights = [freq for _, freq in runs]
    counts: Counter[str] = Counter()
    where: dict[str, set[int]] = defaultdict(set)
    changed: set[str] = set()

    def count(i: int, sign: int) -> None:
        for pair in map("".join, zip(texts[i], texts[i][1:])):
            counts[pair] += sign * weights[i]
            where[pair].add(i)
            changed.add(pair)

    for i in range(len(texts)):
        count(i, 1)
    merges: list[Merge] = []
    queue: list[tuple[int, str]] = []
    while room > 0:
        for pair in changed:
            if (-counts[pair], pair) < bound:
                heappush(queue, (-counts[pair], pair))
        changed.clear()
        while queue and counts[queue[0][1]] != -queue[0][0]:
            heappop(queue)
        if not queue:
            break
        pair = queue[0][1]
        left, right = map(token_id, pair)
        name = names[left] + names[right]
        known = name in tokens
        if not known:
            tokens[name] = len(names)
            names.append(name)
            room -= 1
        merges.append(Merge(left, right, tokens[name], counts[pair]))
        if known:
            break
        for i in where.pop(pair):
            count(i, -1)
            texts[i] = texts[i].replace(pair, symbol(tokens[name]))
            count(i, 1)
    return merges


def next_merges(
    table: DataFrame, hot_pairs: int, tokens: dict[bytes, int], names: list[bytes], room: int
) -> tuple[list[Merge], int]:
    """The next merges in exact order, and how many hot pairs to try next time.

    The first pairs by ``(-freq, pair)`` are hot and ``bound`` is the next one.
    A pair of joined symbols is never more frequent than the two symbols that
    meet in it were, and its ids are no smaller. So every merge before the bound
    happens inside a run of hot pairs. The runs, counted over all words, are all
    the driver needs; it asks for fewer hot pairs until they are few.
    """
    top = (
        symbol_pairs(table)
        .orderBy(F.desc("freq"), F.asc("pair"))
        .limit(hot_pairs + 1)
        .collect()
    )
    while hot_pairs > 1 and top:
        bound = (0, "")
        if len(top) > hot_pairs:
            bound = (-top[hot_pairs]["freq"], top[hot_pairs]["pair"])
        runs = hot_runs(table, [row["pair"] for row in top[:hot_pairs]]).persist()
        size = runs.agg(
            F.count(F.lit(1)).alias("runs"), F.sum(F.length("run")).alias("symbols")
        ).first()
        if size["runs"] <= MAX_RUNS and size["symbols"] <= 16 * MAX_RUNS:
            merges = merge_runs([tuple(r) for r in runs.collect()], bound, tokens, names, room)
            runs.unpersist()
            roomy = size["runs"] <= MAX_RUNS // 4
            return merges, min(MAX_HOT_PAIRS, 2 * hot_pairs) if roomy else hot_pairs
        runs.unpersist()
        hot_pairs //= 2
    # The first pair alone is always right.
    first = [(row["pair"], row["freq"]) for row in top[:1]]
    return merge_runs(first, (0, ""), tokens, names, min(room, 1)), 2


def train(counts: DataFrame, vocab_size: int, eos: str = EOS) -> Tokenizer:
    """Learn merges from a ``(word, freq)`` table until ``vocab_size`` tokens.

    Pairs are taken by frequency, ties by left then right id.
    """
    if vocab_size > MAX_TOKENS:
        raise ValueError(f"vocab_size above {MAX_TOKENS}")
    spark = counts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    names = Tokenizer(eos=eos).token_bytes()
    tokens = {name: i for i, name in enumerate(names)}
    merges: list[Merge] = []
    batch: list[Merge] = []
    path, table, hot_pairs = None, symbol_words(counts), FIRST_HOT_PAIRS
    rounds = 0
    try:
        while len(names) < vocab_size:
            # The last merge of a batch may give a token that the others use.
            merged = table.select(
                apply_merges(apply_merges(F.col("symbols"), batch[:-1]), batch[-1:]).alias("symbols"),
                "freq",
            )
            left = merged.where(F.length("symbols") > 1)
            new_path = write_scratch(left if path else left.repartition(cores), "bpe-words")
            if path:
                drop_scratch(spark, path)
            path = new_path
            table = spark.read.schema(merged.schema).parquet(path)
            batch, hot_pairs = next_merges(
                table, hot_pairs, tokens, names, vocab_size - len(names)
            )
            rounds += 1
            if not batch:
                break
            # A pair can only come up again through a reused token; its first rank counts.
            known = {m[:2] for m in merges}
            merges += [m for m in batch if m[:2] not in known]
            LOG.info("round %d: %d merges, %d tokens", rounds, len(batch), len(names))
    finally:
        if path:
            drop_scratch(spark, path)
    return Tokenizer(tuple(merges), eos)


def merges_table(spark, tokenizer: Tokenizer) -> DataFrame:
    rows = [(rank, *m) for rank, m in enumerate(tokenizer.merges)]
    return spark.createDataFrame(
        rows, "rank bigint, left_id bigint, right_id bigint, new_id bigint, freq bigint"
    )


def vocab_table(spark, tokenizer: Tokenizer) -> DataFrame:
    rows = [(i, bytearray(t), i == EOS_ID) for i, t in enumerate(tokenizer.token_bytes())]
    return spark.createDataFrame(rows, "token_id bigint, token binary, special boolean")
