"""Secret scan: all rules in one minimised automaton that reads every byte once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.automaton import Dfa, backwards, combined
from corpusprep.llm.common import documents, id_and_text


class Rule(NamedTuple):
    """A pattern over bytes and a test that its matches must pass."""

    kind: str
    pattern: str
    any_case: bool = False
    valid: Callable[[bytes], bool] | None = None


def long_value(found: bytes) -> bool:
    """Whether what is assigned has at least eight characters."""
    at = min(i for i in (found.find(b":"), found.find(b"=")) if i >= 0)
    value = found[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 8


class AtLeast(NamedTuple):
    size: int

    def __call__(self, found: bytes) -> bool:
        return len(found) >= self.size


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        any_case=True,
        valid=long_value,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", valid=AtLeast(16)),
    # A run of any length would do as pattern; six digits keep common words from matching.
    Rule("hex", r"[0-9a-f]{6,}", valid=AtLeast(32)),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", valid=AtLeast(40)),
    Rule("google", r"AIza[A-Za-z0-9_-]+", valid=AtLeast(39)),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
)


class Scanner:
    """Finds leftmost, longest, non-overlapping matches of each rule.

    The forward automaton reports where a match of a rule stops being extensible;
    the rule's backward automaton then finds the smallest start after its last
    match. Matches that fail a rule's test are dropped and not tried again.
    """

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.forward = combined([(r.pattern, r.any_case) for r in rules])
        self.back = [backwards(r.pattern, r.any_case) for r in rules]

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(position, rules whose match ends there and no longer grows)"""
        rows, accepts = self.forward.rows, self.forward.accepts
        accepting = self.forward.first_accepting
        state = live = 0
        for at, byte in enumerate(data):
            state = rows[state][byte]
            if state >= accepting:
                now = accepts[state]
                if live & ~now:
                    yield at, live & ~now
                live = now
            elif live:
                yield at, live
                live = 0
        if live:
            yield len(data), live

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, ordered."""
        done = [0] * len(self.rules)
        found = []
        for end, which in self.ends(data):
            for k, rule in enumerate(self.rules):
                if which >> k & 1:
                    start = smallest_start(self.back[k], data, end, done[k])
                    if start is not None:
                        done[k] = end
                        if rule.valid is None or rule.valid(data[start:end]):
                            found.append((start, k, end))
        return sorted(found)


def smallest_start(back: Dfa, data: bytes, end: int, least: int) -> int | None:
    state, start = 0, None
    for at in range(end - 1, least - 1, -1):
        state = back.rows[state][data[at]]
        if state >= back.first_accepting:
            start = at
        elif state == back.dead:
            break
    return start


def code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points; every border is an ASCII byte's."""
    if len(data) == 0 or data.isascii():
        return found
    place, at, seen = {}, 0, 0
    for border in sorted({b for s, _, e in found for b in (s, e)}):
        seen += len(data[at:border].decode())
        at = border
        place[border] = seen
    return [(place[s], k, place[e]) for s, k, e in found]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (array of kind, start, end).

    Starts and ends count code points, end exclusive, ordered by start and then
    by rule. Null and empty texts have no spans; repeated rows and null ids give
    a row each. No row moves: the only state is the automaton, whose size hangs on
    the rules alone.
    """
    kinds = [r.kind for r in rules]
    scanner = Scanner(rules)  # built once; tasks receive its arrays

    def scan(batches):
        for batch in batches:
            spans = []
            for text in batch["text"]:
                data = text.encode() if text else b""
                found = code_points(data, scanner.spans(data))
                spans.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in found])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    kind_of_id = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind_of_id}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return id_and_text(docs).mapInPandas(scan, schema)


def op6_secrets(spark, sf_dir):
    """Counts, digest and all spans of every document."""
    found = scan_secrets(documents(spark, sf_dir))
    base = [r.kind for r in BASE_RULES]
    text_of = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text_of), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
