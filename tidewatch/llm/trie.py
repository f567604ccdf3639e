"""A trie of globally ordered sets with shared partial overlaps, for joins inside one bounded group of sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Node:
    """A run of elements, what follows it, and the bounds of the sets below: least size, most elements after the run."""

    __slots__ = ("after", "below", "ends", "least", "run")

    def __init__(self, run: np.ndarray) -> None:
        self.run, self.below, self.ends, self.least, self.after = run, {}, [], 1 << 60, 0


class Union:
    def __init__(self, labels: list) -> None:
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def insert(top: Node, elements: np.ndarray, size: int, which: int) -> None:
    node, at = top, 0
    while True:
        node.least = min(node.least, size)
        node.after = max(node.after, len(elements) - at)
        if at == len(elements):
            node.ends.append(which)
            return
        head = int(elements[at])
        child = node.below.get(head)
        if child is None:
            child = node.below[head] = Node(elements[at:])
            child.least, child.ends = size, [which]
            return
        n = min(len(child.run), len(elements) - at)
        differ = child.run[:n] != elements[at : at + n]
        same = int(differ.argmax()) if differ.any() else n
        if same < len(child.run):  # split the run where the two part
            upper = Node(child.run[:same])
            upper.least, upper.after = child.least, child.after + len(child.run) - same
            child.run = child.run[same:]
            upper.below[int(child.run[0])] = child
            node.below[head] = child = upper
        node, at = child, at + same


def join_group(sets: list[np.ndarray], sizes: list[int], labels: list, worth: Callable[[int, int, int], bool], met: Callable[[int, int, int], bool]) -> Union:
    """Union of the sets of a group for which `met(overlap, i, j)` holds.

    Each set is an ascending array of places in one global order, and goes into the trie in that order. A set is looked
    for from the root with its overlap so far, which all sets below share; a subtree is left when `worth(most, i, least)`
    does not hold: `most` is the overlap and all that can follow of either side, `least` the smallest size below. Sets
    that are already in one class need no comparison.
    """
    union = Union(labels)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if sets else (np.zeros(0),) * 3
    shared = counts > 1  # elements of a single set cannot overlap: they only count in sizes
    number = np.cumsum(shared) - 1
    member = np.zeros(int(shared.sum()), bool)
    top = Node(np.zeros(0, np.int64))
    parts = np.split(inverse, np.cumsum([len(x) for x in sets])[:-1]) if sets else []
    for i, part in enumerate(parts):
        own = number[part[shared[part]]]
        roots = {union.root(j) for j in range(i)}
        if roots and not (len(roots) == 1 and union.root(i) in roots):
            member[own] = True
            stack = [(top, 0)]
            while stack:
                node, overlap = stack.pop()
                rest = len(own)
                if len(node.run):
                    overlap += int(np.count_nonzero(member[node.run]))
                    rest -= int(np.searchsorted(own, node.run[-1], side="right"))
                if not worth(overlap + min(rest, node.after), i, node.least):
                    continue
                for j in node.ends:
                    if union.root(i) != union.root(j) and met(overlap, i, j):
                        union.join(i, j)
                        roots = {union.root(k) for k in range(i)}
                if len(roots) == 1 and union.root(i) in roots:
                    break
                stack += [(child, overlap) for child in node.below.values()]
            member[own] = False
        insert(top, own, sizes[i], i)
    return union


def link_group(sets: list[np.ndarray], labels: list, numerator: int, denominator: int, certain: Callable[[int, int], bool] = lambda i, j: True) -> Union:
    """Union of the sets that are linked: denominator * |A and B| >= numerator * |A or B|, if `certain` says so too."""
    sizes, both = [len(x) for x in sets], numerator + denominator
    worth = lambda most, i, least: both * most >= numerator * (sizes[i] + least)
    met = lambda overlap, i, j: both * overlap >= numerator * (sizes[i] + sizes[j]) and certain(i, j)
    return join_group(sets, sizes, labels, worth, met)
