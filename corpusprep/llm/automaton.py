"""Byte automata: a small regex syntax, subset construction and minimisation.

Syntax: literals, ``\\x20`` escapes, ``[...]`` classes, groups, ``|``, ``? * +``,
``{n}``, ``{n,}`` and ``{n,m}``.
"""

from __future__ import annotations

import numpy as np


class Nfa:
    """Thompson automaton; ``moves`` are (from, byte set, to)."""

    def __init__(self) -> None:
        self.size = 0
        self.moves: list[tuple[int, frozenset[int], int]] = []
        self.empty: list[tuple[int, int]] = []

    def state(self) -> int:
        self.size += 1
        return self.size - 1


class Parser:
    def __init__(self, nfa: Nfa, pattern: str, any_case: bool = False) -> None:
        self.nfa, self.text, self.at, self.any_case = nfa, pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            if self.peek() == "x":
                self.at += 3
                return int(self.text[self.at - 2 : self.at], 16)
            c = self.text[self.at]
            self.at += 1
        return ord(c)

    def alternatives(self) -> tuple[int, int]:
        start, end = self.nfa.state(), self.nfa.state()
        while True:
            a, b = self.sequence()
            self.nfa.empty += [(start, a), (b, end)]
            if self.peek() != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() and self.peek() not in "|)":
            begin = self.at
            a, b = self.atom()
            after = self.at
            low, high = self.repeat()
            to = self.at
            pieces = [(a, b)]
            for _ in range(max(low, 1 if high is None else high, 1) - 1):
                self.at = begin
                pieces.append(self.atom())
            self.at = to if to != after else after
            final = self.nfa.state()
            for i, (x, y) in enumerate(pieces):
                if i >= low:
                    self.nfa.empty.append((end, final))
                self.nfa.empty.append((end, x))
                end = y
            if high is None:
                self.nfa.empty.append((end, pieces[-1][0]))
            self.nfa.empty.append((end, final))
            end = final
        return start, end

    def repeat(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c != "{":
            return 1, 1
        inside = self.text[self.at + 1 : self.text.index("}", self.at)]
        self.at += len(inside) + 2
        low, comma, high = inside.partition(",")
        return int(low), int(high) if high else (None if comma else int(low))

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.at += 1
            inner = self.alternatives()
            self.at += 1
            return inner
        if self.peek() == "[":
            self.at += 1
            chosen: set[int] = set()
            while self.peek() != "]":
                low = high = self.char()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self.char()
                chosen |= set(range(low, high + 1))
            self.at += 1
        else:
            chosen = {self.char()}
        if self.any_case:
            letters = {c for c in chosen if chr(c).isalpha()}
            chosen |= {ord(chr(c).swapcase()) for c in letters}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves.append((a, frozenset(chosen), b))
        return a, b


class Dfa:
    """``rows[state][byte]`` is the next state; ``accepts[state]`` a bit per rule.

    State 0 is the start. States from ``first_accepting`` on accept something.
    ``dead`` leads only to itself (-1: none). Pickles as one small array.
    """

    def __init__(self, table: np.ndarray, accepts: list[int], first_accepting: int) -> None:
        self.table, self.accepts, self.first_accepting = table, accepts, first_accepting
        self.rows: list[list[int]] = table.tolist()
        stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1))
        self.dead = next((int(s) for s in stuck if s < first_accepting), -1)

    def __reduce__(self):
        return Dfa, (self.table, self.accepts, self.first_accepting)


def determinise(nfa: Nfa, starts: set[int], finals: dict[int, int], restart: bool) -> Dfa:
    """Subset construction. With ``restart`` a match may begin at every byte."""
    empty: dict[int, list[int]] = {}
    for a, b in nfa.empty:
        empty.setdefault(a, []).append(b)
    moves: dict[int, list[tuple[frozenset[int], int]]] = {}
    for a, on, b in nfa.moves:
        moves.setdefault(a, []).append((on, b))
    kinds = np.zeros(256, np.int64)  # bytes that every move treats alike
    for on in {on for _, on, _ in nfa.moves}:
        kinds = np.unique(kinds * 2 + np.isin(np.arange(256), list(on)), return_inverse=True)[1]
    samples = [int(np.flatnonzero(kinds == k)[0]) for k in range(kinds.max() + 1)]

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for b in empty.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(s for s in seen if s in moves or s in finals)

    first = closed(starts)
    number, order, table = {first: 0}, [first], []
    for here in order:
        row = []
        for byte in samples:
            to = {b for s in here for on, b in moves.get(s, ()) if byte in on}
            target = closed(to | starts if restart else to)
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    accepts = [0] * len(order)
    for i, here in enumerate(order):
        for s in here:
            accepts[i] |= finals.get(s, 0)
    return minimise(np.array(table)[:, kinds], np.array(accepts))


def minimise(table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Merge states that no continuation tells apart, accepting ones numbered last."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    chosen = np.zeros(count, np.int64)
    chosen[block[::-1]] = np.arange(len(block))[::-1]  # the first state of each block
    kind = (accepts[chosen] > 0).astype(int)
    order = sorted(range(count), key=lambda k: (kind[k], k != block[0], k))
    place = np.zeros(count, np.int64)
    place[order] = np.arange(count)
    rows = place[block[table[chosen[order]]]]
    rows = rows.astype(np.min_scalar_type(count))
    return Dfa(rows, accepts[chosen[order]].tolist(), int((kind == 0).sum()))


def combined(patterns: list[tuple[str, bool]]) -> Dfa:
    """One automaton for all patterns that can begin at any byte; bit k is pattern k."""
    nfa, starts, finals = Nfa(), set(), {}
    for k, (pattern, any_case) in enumerate(patterns):
        a, b = Parser(nfa, pattern, any_case).alternatives()
        starts.add(a)
        finals[b] = 1 << k
    return determinise(nfa, starts, finals, restart=True)


def backwards(pattern: str, any_case: bool) -> Dfa:
    """An automaton that reads a match of the pattern from its end to its start."""
    nfa = Nfa()
    a, b = Parser(nfa, pattern, any_case).alternatives()
    nfa.moves = [(y, on, x) for x, on, y in nfa.moves]
    nfa.empty = [(y, x) for x, y in nfa.empty]
    return determinise(nfa, {b}, {a: 1}, restart=False)
