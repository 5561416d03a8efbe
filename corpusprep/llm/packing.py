"""Mixture-controlled packing: deficit round-robin over one token queue per source."""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.functions.bytelevel import PRINTED
from corpusprep.llm.common import documents, from_planes, planes, small_batches
from corpusprep.sources.scratch import materialize

SEQUENCE_TOKENS = 1024
WINDOW_TOKENS = 64 * SEQUENCE_TOKENS
END_ID = 0
MAX_QUEUES = 256
TURN_TOKENS = 64  # of a source in a window of its group, on average at least
BORDERS = 1 << 20  # numbers of a schedule's windows that a task keeps

# Only texts of these characters, in which all cutters of words agree, and without
# very long blanks take the fast way; the library encodes all others.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e¡«»¿-ɏ–—‘’“”…€]*")
LONG_BLANK = re.compile(r"\s{500}")
# Fixed value: how byte-level BPE cuts text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts under a byte-level BPE file of the ``tokenizers`` library.

    If the file's ids follow its merges, which is checked, a second implementation
    of the same merges encodes plain texts; it gives equal ids in a fraction of the time.
    Texts that hold an added token, such as the end mark, go to the library, which
    gives that token's one id.
    """

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        spec = json.loads(model)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = same_merges(spec)

    def encode(self, text: str) -> np.ndarray:
        plain = self.fast and PLAIN.fullmatch(text) and not LONG_BLANK.search(text)
        if plain and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def same_merges(spec: dict):
    """An encoder by ranks if the file's ids and merges are in one order, else None."""
    import tiktoken

    byte = {c: b for b, c in PRINTED.items()}
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    order = sorted(ranks, key=ranks.get)
    if (
        cutter.get("type") != "ByteLevel"
        or cutter.get("add_prefix_space")
        or spec.get("normalizer")
        or set(order[:256]) != set(byte)
        or order[256:] != merged
        or [ranks[t] for t in order] != list(range(len(order)))
    ):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in ranks.items()}
    return tiktoken.Encoding("ranks", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


class Schedule:
    """How far each queue is after any number of windows, without counting up to it.

    In a window a queue's credit grows by its quantum, its share of the window
    among the queues that are not empty; it gives the whole tokens of its credit
    and carries the rest, its deficit, into the next window. Between two moments at
    which a queue runs empty this is linear, so what was taken up to window ``w`` is
    ``taken + (deficit + windows * quantum) // unit`` in whole numbers. Each task
    gets the state of any window from this and needs no other task's windows.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.totals = totals
        self.phases: list[tuple[int, list[int], list[int], list[int], int]] = []
        taken, deficit, unit, at = [0] * len(totals), [0] * len(totals), 1, 0
        while any(c < t for c, t in zip(taken, totals)):
            alive = [c < t for c, t in zip(taken, totals)]
            share = [w if live else 0 for w, live in zip(weights, alive)]
            if not any(share):  # only queues without a share are left
                share = [int(live) for live in alive]
            deficit = [d * sum(share) // unit for d in deficit]
            unit = sum(share)
            quantum = [window * s for s in share]
            self.phases.append((at, taken, deficit, quantum, unit))
            needed = [
                -(-((t - c) * unit - d) // q)
                for t, c, d, q in zip(totals, taken, deficit, quantum)
                if q
            ]
            at += max(1, min(needed))
            state = self.phases[-1]
            taken, left = self.after(at, state), at - state[0]
            deficit = [(d + left * q) % unit for d, q in zip(deficit, quantum)]
        self.starts = [[p[1][s] for p in self.phases] for s in range(len(totals))]
        self.keep_borders()

    def keep_borders(self) -> None:
        """Fewer windows are kept of a schedule with more queues."""
        self.border = lru_cache(maxsize=max(16, BORDERS // max(1, len(self.totals))))(self.find_border)

    def after(self, window: int, phase) -> list[int]:
        """Tokens that each queue has given when ``window`` windows are full."""
        first, taken, deficit, quantum, unit = phase
        n = window - first
        return [
            min(t, c + (d + n * q) // unit)
            for t, c, d, q in zip(self.totals, taken, deficit, quantum)
        ]

    def find_border(self, phase: int, window: int) -> tuple[list[int], list[int], list[int]]:
        """Before and after a window, and where each queue's tokens start in the stream."""
        before = self.after(window - 1, self.phases[phase])
        after = self.after(window, self.phases[phase])
        at, starts = sum(before), []
        for b, a in zip(before, after):
            starts.append(at)
            at += a - b
        return before, after, starts

    def runs(self, queue: int, start: int, count: int):
        """(offset, length, stream position) of a document's tokens, window by window."""
        at, end = start, start + count
        while at < end:
            phase = bisect_right(self.starts[queue], at) - 1
            first, taken, deficit, quantum, unit = self.phases[phase]
            need = (at - taken[queue] + 1) * unit - deficit[queue]
            window = first + max(1, -(-need // quantum[queue]))
            before, after, starts = self.border(phase, window)
            length = min(end, after[queue]) - at
            yield at - start, length, starts[queue] + at - before[queue]
            at += length

    def __reduce__(self):
        return _schedule, (self.totals, self.phases, self.starts)


def _schedule(totals, phases, starts) -> Schedule:
    made = Schedule.__new__(Schedule)
    made.totals, made.phases, made.starts = totals, phases, starts
    made.keep_borders()
    return made


def token_table(docs: DataFrame, model: str) -> DataFrame:
    """Documents as ids, with each one's place among its task's tokens of the source."""

    def encode(batches):
        part, given = TaskContext.get().partitionId(), {}
        encode_one = encoder(model).encode
        for batch in small_batches(batches):
            starts, ids = [], []
            for source, text in zip(batch["source"].to_pylist(), batch["text"]):
                ids.append(np.append(encode_one(text.as_py() or ""), np.uint32(END_ID)))
                starts.append(given.get(source, 0))
                given[source] = starts[-1] + len(ids[-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "source": batch["source"],
                    "part": pa.array([part] * len(ids), pa.int32()),
                    "start": pa.array(starts, pa.int64()),
                    "n": pa.array([len(x) for x in ids], pa.int64()),
                    "ids": pa.array([planes(x) for x in ids], pa.binary()),
                }
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, part int, start bigint, n bigint, ids binary"
    return materialize(docs.mapInArrow(encode, schema), "tokens")


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    targets: dict[str, float] | None = None,
    sequence: int = SEQUENCE_TOKENS,
    window: int = WINDOW_TOKENS,
    max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """Cut all documents (``doc_id``, ``source``, ``text``) into pieces of full sequences.

    Returns a row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``source``. Each document is its ids
    and id 0. ``targets`` are the token shares of the sources in every window; the
    default is their share of all tokens, so all queues end together. A queue that
    runs empty leaves its share to the others; sources without a target come when
    the others are empty. Only the last sequence of all can be short.

    With fewer than ``max_queues`` sources each has a queue of its own. With more, half
    as many queues go to the largest ones, and every source with a target has one; the
    others are dealt over groups, each of which is a queue that a second round-robin
    fills by the shares of the group's sources. Its window is the group's share of a
    window, or longer, so that a source has ``TURN_TOKENS`` in it on average. A null
    source is a source, a null or empty text is id 0 alone, repeated rows are packed
    each, null ids stay null.

    Ids are written once, in the tasks that read the texts, and never shuffled
    unless the table of task offsets is too large to be broadcast.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        from public_tokenizers import path

        tokenizer_path = path("byte_bpe_50k.json")
    with open(tokenizer_path, encoding="utf-8") as file:
        model = file.read()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    tokens = token_table(rows, model)
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "sums")
    offsets, totals, names, groups = queue_offsets(spark, sums, max_queues, targets or {})
    weights = totals
    if targets:
        weights = [round(1_000_000 * targets.get(n, 0)) if n is not None else 0 for n in names] + [0] * len(groups)
    schedule = Schedule(totals, weights, window)
    every = max(1, sum(totals))
    turns = [Schedule(g, g, max(1, window * sum(g) // every, TURN_TOKENS * len(g))) for g in groups]

    def places(row):
        start = row.base + row.start
        if row.queue < len(names):
            yield from schedule.runs(row.queue, start, row.n)
            return
        for first, count, at in turns[row.queue - len(names)].runs(row.member, start, row.n):
            for more, length, place in schedule.runs(row.queue, at, count):
                yield first + more, length, place

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ids = from_planes(row.ids, "<u4").tobytes()
                for start, length, at in places(row):
                    while length:
                        take = min(length, sequence - at % sequence)
                        crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + take)])
                        out.append((row.doc_id, start, take, crc, row.n, at // sequence, at % sequence, row.source))
                        start, length, at = start + take, length - take, at + take
            yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    columns = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, "
        "doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    )
    place = offsets.select(F.col("source").alias("of"), F.col("part").alias("task"), "queue", "member", "base")
    same = (F.col("part") == F.col("task")) & F.col("source").eqNullSafe(F.col("of"))
    placed = tokens.join(place, same).select("doc_id", "source", "start", "n", "ids", "queue", "member", "base")
    return placed.mapInPandas(cut, columns)


def queue_offsets(spark: SparkSession, sums: DataFrame, max_queues: int, targets: dict[str, float]):
    """Queue, place in its group and first token of every (source, task).

    Also the tokens of each queue, the sources that have one of their own, and the
    tokens of every source of each group; the groups' queues come last.
    """
    by_source = materialize(sums.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    of_own = max_queues - 1 if by_source.count() < max_queues else (max_queues + 1) // 2
    order = (F.desc("n"), F.asc_nulls_first("source"))
    largest = [(r.source, r.n) for r in by_source.orderBy(*order).limit(of_own).collect()]
    wanted = spark.createDataFrame([(t,) for t in targets if t is not None], "source string")
    known = {n for n, _ in largest}
    named = [(r.source, r.n) for r in by_source.join(F.broadcast(wanted), "source").orderBy(*order).collect()]
    largest += [(n, total) for n, total in named if n not in known]
    names, totals = [n for n, _ in largest], [total for _, total in largest]
    own = [(n, i) for i, n in enumerate(names)]
    own = F.broadcast(spark.createDataFrame(own, "name string, queue int").withColumn("member", F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("name"))
    rest = by_source.join(own, same, "left_anti")
    many = rest.count()
    buckets = max(1, max_queues // 2, math.isqrt(many))
    bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int").alias("bucket")
    in_group = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("name"))
    rest = rest.select(F.col("source").alias("name"), "n", bucket).withColumn("member", F.row_number().over(in_group) - 1)
    rest = materialize(rest, "rest")
    found = rest.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("member", "n"))).alias("of")).orderBy("bucket").collect()
    groups = [[m.n for m in r.of] for r in found]
    queues = [(r.bucket, len(names) + i) for i, r in enumerate(found)]
    queues = F.broadcast(spark.createDataFrame(queues, "bucket int, queue int"))
    placed = own.unionByName(rest.join(queues, "bucket").select("name", "queue", "member"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    firsts = sums.select("source", "part", base)
    offsets = materialize(firsts.join(placed, same).select("source", "part", "queue", "member", "base"), "offsets")
    return offsets, totals + [sum(g) for g in groups], names, groups


def op3_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
