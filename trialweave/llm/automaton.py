"""Rule regexes to one minimal deterministic automaton over bytes.

A rule is parsed into a nondeterministic automaton; all rules together are made
deterministic by subset construction over classes of bytes that no rule tells apart, and
then minimal by refining partitions. States carry a bit set of the rules that end there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Parser:
    """Literals, escapes, classes, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`, `{m,n}` -> a syntax tree."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.choice()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return c

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeat())
        return ("and", items)

    def repeat(self):
        item = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                inside = ""
                while self.peek() != "}":
                    inside += self.take()
                self.take()
                first, comma, last = inside.partition(",")
                low, high = int(first), int(last) if last else None if comma else int(first)
            item = ("repeat", item, low, high)
        return item

    def atom(self):
        c = self.take()
        if c == "(":
            tree = self.choice()
            if self.take() != ")":
                raise ValueError(f"group not closed in {self.text!r}")
            return tree
        if c == "[":
            return ("bytes", self.cased(self.members()))
        if c == "\\":
            return ("bytes", self.cased({self.escape()}))
        return ("bytes", self.cased({ord(c)}))

    def escape(self) -> int:
        c = self.take()
        return int(self.take() + self.take(), 16) if c == "x" else ord(c)

    def members(self) -> set[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escape() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
            found |= set(range(low, high + 1))
        self.take()
        return set(ALL - found) if negated else found

    def cased(self, members: set[int]) -> frozenset[int]:
        if self.any_case:
            members = members | {ord(chr(b).swapcase()) for b in members if b < 128}
        return frozenset(members)


def reversed_tree(tree):
    kind = tree[0]
    if kind == "and":
        return ("and", [reversed_tree(t) for t in reversed(tree[1])])
    if kind == "or":
        return ("or", [reversed_tree(t) for t in tree[1]])
    if kind == "repeat":
        return ("repeat", reversed_tree(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def build(self, tree, start: int) -> int:
        """Add the tree behind `start`; returns where it ends."""
        kind = tree[0]
        if kind == "bytes":
            end = self.node()
            inner = self.node()
            self.free[start].append(inner)
            self.step[inner] = (tree[1], end)
            return end
        if kind == "and":
            for item in tree[1]:
                start = self.build(item, start)
            return start
        if kind == "or":
            end = self.node()
            for item in tree[1]:
                self.free[self.build(item, start)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            start = self.build(item, start)
        end = self.node()
        if high is None:
            loop = self.node()
            self.free[start].append(loop)
            self.free[self.build(item, loop)].append(loop)
            self.free[loop].append(end)
            return end
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.build(item, start)
            self.free[start].append(end)
        return end

    def closure(self, nodes) -> frozenset[int]:
        seen, stack = set(nodes), list(nodes)
        while stack:
            for n in self.free[stack.pop()]:
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return frozenset(seen)


@dataclass
class Automaton:
    """next[state, classes[byte]] is the next state; rules[state] the bit set of rules that end there."""

    classes: np.ndarray
    next: np.ndarray
    rules: np.ndarray
    start: int
    dead: int

    def rows(self) -> list[list]:
        """Transition rows linked to each other, one entry per byte, the bit set at 256, the state at 257."""
        linked: list[list] = [[] for _ in range(len(self.next))]
        full = self.next[:, self.classes]
        for state, row in enumerate(linked):
            row += [linked[t] for t in full[state].tolist()]
            row += [int(self.rules[state]), state]
        return linked


def byte_classes(sets: list[frozenset[int]]) -> np.ndarray:
    marks: dict[tuple[bool, ...], int] = {}
    return np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], np.int64)


def determinise(trees: list, anywhere: bool) -> Automaton:
    """Subset construction; with `anywhere` a match may begin at every byte."""
    nfa = _Nfa()
    root = nfa.node()
    ends: dict[int, int] = {}
    for rule, tree in enumerate(trees):
        begin = nfa.node()
        nfa.free[root].append(begin)
        end = nfa.build(tree, begin)
        ends[end] = ends.get(end, 0) | 1 << rule
    distinct = list({s[0] for s in nfa.step if s})
    classes = byte_classes(distinct)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    first = nfa.closure([root])
    known, order, table = {first: 0}, [first], []
    closed: dict[frozenset[int], frozenset[int]] = {}
    for state in order:  # grows while it is walked
        moves = [nfa.step[n] for n in state if nfa.step[n]]
        row = []
        for byte in sample:
            reached = {target for members, target in moves if byte in members}
            if anywhere:
                reached.add(root)
            key = frozenset(reached)
            after = closed.get(key)
            if after is None:
                after = closed[key] = nfa.closure(key)
            if after not in known:
                known[after] = len(order)
                order.append(after)
            row.append(known[after])
        table.append(row)
    rules = np.array([sum({ends[n] for n in state if n in ends}) for state in order], np.int64)
    return minimise(Automaton(classes, np.array(table, np.int64), rules, 0, -1))


def minimise(dfa: Automaton) -> Automaton:
    """Refine the partition by accepted rules until successors agree block by block."""
    block = np.unique(dfa.rules, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.concatenate([block[:, None], block[dfa.next]], axis=1)
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    head = np.unique(block, return_index=True)[1]
    nxt, rules = block[dfa.next[head]], dfa.rules[head]
    loops = (nxt == np.arange(len(nxt))[:, None]).all(axis=1) & (rules == 0)
    dead = int(np.flatnonzero(loops)[0]) if loops.any() else -1
    return Automaton(dfa.classes, nxt.astype(np.int32), rules, int(block[dfa.start]), dead)


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).parse()


def combined(patterns: list[tuple[str, bool]]) -> Automaton:
    """All rules in one automaton that reports, at each byte, the rules with a match ending there."""
    return determinise([parse(p, c) for p, c in patterns], anywhere=True)


def backward(pattern: str, any_case: bool = False) -> Automaton:
    """The rule read from its end; finds where a match that ends here can begin."""
    return determinise([reversed_tree(parse(pattern, any_case))], anywhere=False)
