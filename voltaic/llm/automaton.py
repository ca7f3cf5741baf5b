"""Byte-level regular expressions as one deterministic automaton.

Rules are parsed to a Thompson graph, turned into one automaton by subset construction with a set of rules that
end in each state, and minimised by partition refinement. The result is a transition array over byte classes.
Syntax: literals, ``.``-free classes ``[...]``, groups, ``|``, ``? * +``, ``{m}``, ``{m,}``, ``\\xNN`` and escapes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Graph:
    """Thompson's construction: epsilon edges and edges over sets of bytes."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1

    def build(self, tree: tuple, start: int) -> int:
        """Add ``tree`` from ``start``; its end."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.step[start].append((tree[1], end))
            return end
        if kind == "seq":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.node()
            for part in tree[1]:
                first = self.node()
                self.eps[start].append(first)
                self.eps[self.build(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop = self.node()
            self.eps[start].append(loop)
            self.eps[self.build(part, loop)].append(loop)
            return loop
        end = self.node()
        for _ in range(most - least):
            self.eps[start].append(end)
            start = self.build(part, start)
        self.eps[start].append(end)
        return end


def parse(pattern: str, fold: bool = False) -> tuple:
    """The tree of ``pattern``; ``fold``: ASCII letters stand for either case."""
    at = 0

    def both(byte: int) -> frozenset[int]:
        c = chr(byte)
        return frozenset({ord(c.lower()), ord(c.upper())}) if fold and c.isascii() and c.isalpha() else frozenset({byte})

    def escaped() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        return escaped() if c == "\\" else ord(c)

    def choice() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence() -> tuple:
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("seq", parts)

    def repeated() -> tuple:
        nonlocal at
        part = single()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = ("rep", part, least, most)
        return part

    def single() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            part = choice()
            at += 1
            return part
        if pattern[at] != "[":
            return ("set", both(char()))
        at += 1
        found: set[int] = set()
        while pattern[at] != "]":
            low = high = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = char()
            for b in range(low, high + 1):
                found |= both(b)
        at += 1
        return ("set", frozenset(found))

    return choice()


@dataclass(frozen=True)
class Automaton:
    """``table[state, classes[byte]]`` is the next state; ``ends[state]`` has a bit for each rule that ends there. State 0 is the start."""

    table: np.ndarray
    classes: np.ndarray
    ends: np.ndarray

    @property
    def by_byte(self) -> np.ndarray:
        """The transitions over plain bytes."""
        return self.table[:, self.classes]


def _reverse(tree: tuple) -> tuple:
    if tree[0] == "set":
        return tree
    if tree[0] == "seq":
        return ("seq", [_reverse(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_reverse(x) for x in tree[1]])
    return ("rep", _reverse(tree[1]), *tree[2:])


def compile_rules(trees: list[tuple], anchored: bool = False, backward: bool = False) -> Automaton:
    """One minimal automaton of all ``trees``; unless ``anchored``, a match may begin anywhere."""
    graph = _Graph()
    root = graph.node()
    ends = {}
    for i, tree in enumerate(trees):
        first = graph.node()
        graph.eps[root].append(first)
        ends[graph.build(_reverse(tree) if backward else tree, first)] = 1 << i

    # Bytes that no set tells apart are one class.
    sets = list({s for edges in graph.step for s, _ in edges})
    marks = np.zeros((256, len(sets)), dtype=bool)
    for k, s in enumerate(sets):
        marks[list(s), k] = True
    _, first_byte, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)

    def closure(nodes: set[int]) -> frozenset[int]:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for y in graph.eps[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(x for x in seen if graph.step[x] or x in ends)

    start = closure({root})
    index, order, rows = {start: 0}, [start], []
    for state in order:  # grows while states are found
        row = []
        edges = [e for x in state for e in graph.step[x]]
        for byte in first_byte:
            to = {y for s, y in edges if byte in s}
            if not anchored:
                to.add(root)
            target = closure(to)
            if target not in index:
                index[target] = len(order)
                order.append(target)
            row.append(index[target])
        rows.append(row)
    table = np.array(rows, dtype=np.int32)
    accept = np.array([sum(ends[x] for x in s if x in ends) for s in order], dtype=np.int64)

    # Moore's refinement: states are split by what they accept, then by the blocks that they lead to.
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, first, block = np.unique(block, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))  # the start, found first, stays state 0
    block, first = rank[block.reshape(-1)], np.sort(first)
    return Automaton(block[table[first]].astype(np.int32), classes.astype(np.uint8), accept[first])
