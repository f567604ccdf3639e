"""Regular rules compiled to one minimal deterministic automaton in flat transition arrays.

Supported syntax: literals, escapes, classes, groups, alternation and the quantifiers ? * + {m} {m,} {m,n}.
A rule matches leftmost-longest. The scan needs rules in which a match that starts earlier never
first accepts after one that starts later inside it; rules made of a fixed head and a class run have this.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

MAX_STATES = 60_000


class _Parser:
    """Pattern text to a tree of ('set', bytes), ('cat', [..]), ('alt', [..]), ('rep', node, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.text, self.at, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def parse(self):
        node = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unbalanced pattern {self.text!r}")
        return node

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while (c := self.peek()) and c not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        c = self.peek()
        if c and c in "?*+":
            self.take()
            return ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
        return node

    def code(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def folded(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes |= {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(codes)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unbalanced pattern {self.text!r}")
            return node
        if c == "[":
            self.take()
            negate = self.peek() == "^"
            self.at += negate
            codes: set[int] = set()
            while self.peek() != "]":
                low = high = self.code()
                if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    high = self.code()
                codes.update(range(low, high + 1))
            self.take()
            codes = set(self.folded(codes))
            return ("set", frozenset(range(256)) - codes if negate else frozenset(codes))
        return ("set", self.folded({self.code()}))


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int, reverse: bool) -> int:
        """Build from `start`; returns the end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.empty[start].append(middle)
            self.step[middle] = (node[1], end)
            return end
        if kind == "cat":
            for part in reversed(node[1]) if reverse else node[1]:
                start = self.add(part, start, reverse)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first, reverse)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start, reverse)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.add(part, loop, reverse)].append(loop)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start, reverse)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """`table[state * width + byte_class]` is the next state times width; accepting states come last."""

    classes: bytes
    width: int
    table: list[int]
    start: int
    first_accepting: int
    accepts: list[int]
    dead: int

    @property
    def states(self) -> int:
        return len(self.accepts)


def compile_rules(rules: list[tuple[str, bool]], anchored: bool = False, reverse: bool = False) -> Automaton:
    """Subset construction over byte classes, then minimisation by partition refinement.

    Not anchored: a match may start at each byte. accepts[state] is a bit set of the rules that end there.
    """
    nfa = _Nfa()
    begin, ends = nfa.state(), []
    for pattern, fold in rules:
        first = nfa.state()
        nfa.empty[begin].append(first)
        ends.append(nfa.add(_Parser(pattern, fold).parse(), first, reverse))
    final = {e: 1 << i for i, e in enumerate(ends)}

    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    member = np.zeros((256, len(sets)), bool)
    for i, s in enumerate(sets):
        member[sorted(s), i] = True
    _, sample, classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
    width = len(sample)
    by_class: list[list[list[int]]] = [[[] for _ in range(width)] for _ in nfa.step]
    for q, s in enumerate(nfa.step):
        if s:
            for c in range(width):
                if int(sample[c]) in s[0]:
                    by_class[q][c].append(s[1])

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for q in nfa.empty[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return frozenset(q for q in seen if nfa.step[q] or q in final)

    root = closure([begin])
    ids, todo, rows = {root: 0}, deque([root]), []
    while todo:
        now, row = todo.popleft(), []
        for c in range(width):
            after = closure({x for q in now for x in by_class[q][c]})
            if not anchored:
                after |= root
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
                if len(ids) > MAX_STATES:
                    raise ValueError(f"the rules need over {MAX_STATES} states")
            row.append(ids[after])
        rows.append(row)
    step = np.array(rows, np.int64)
    mask = np.array([sum(final.get(q, 0) for q in s) for s in ids], np.int64)

    block = np.unique(mask, return_inverse=True)[1]
    while True:
        _, refined = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        if refined.max() == block.max():
            break
        block = refined
    count = int(block.max()) + 1
    pick = np.zeros(count, np.int64)
    pick[block] = np.arange(len(block))
    order = np.argsort(mask[pick] > 0, kind="stable")  # accepting blocks last
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    small = rank[block[step[pick[order]]]]
    accepts = mask[pick[order]]
    idle = [s for s in range(count) if not accepts[s] and (small[s] == s).all()]
    return Automaton(
        classes=bytes(classes.astype(np.uint8)),
        width=width,
        table=(small * width).ravel().tolist(),
        start=int(rank[block[0]]) * width,
        first_accepting=int((accepts == 0).sum()) * width,
        accepts=accepts.tolist(),
        dead=idle[0] * width if anchored and idle else -1,
    )


def ends(a: Automaton, data: bytes) -> list[tuple[int, int]]:
    """(end, bit set of rules) for each byte after which some rule accepts: one pass over the bytes."""
    table, state, limit, found = a.table, a.start, a.first_accepting, []
    codes = iter(data.translate(a.classes))
    for c in codes:
        state = table[state + c]
        if state >= limit:  # the position is asked for only here: counting in the loop would double its time
            found.append((len(data) - codes.__length_hint__(), a.accepts[state // a.width]))
    return found


def next_end(a: Automaton, data: bytes, start: int) -> int:
    """The first byte after `start` after which some rule accepts, from a scan that begins there; past the end if none does."""
    table, state, limit, strip = a.table, a.start, a.first_accepting, 256
    while start < len(data):
        for at, c in enumerate(data[start : start + strip].translate(a.classes), start + 1):
            state = table[state + c]
            if state >= limit:
                return at
        start, strip = start + strip, min(4 * strip, 1 << 16)
    return len(data) + 1


def longest(a: Automaton, data: bytes, start: int, stop: int, step: int) -> tuple[int | None, int]:
    """Where the longest match of an anchored automaton ends that begins at `start` and runs to `stop` at most.

    Also how far it looked: the byte that no match can pass, or `stop`.
    """
    table, state, limit, best, classes = a.table, a.start, a.first_accepting, None, a.classes
    at = start
    while at != stop:
        state = table[state + classes[data[at if step > 0 else at - 1]]]
        if state == a.dead:
            break
        at += step
        if state >= limit:
            best = at
    return best, at
