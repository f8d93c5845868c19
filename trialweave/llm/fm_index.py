"""An FM-index over a sequence of word numbers, all steps vectorised over patterns and rows.

The sequence consists of runs of positive numbers, each closed by a 0. Every 0 counts as a
symbol of its own, smaller than all words and ordered by place; so no comparison of suffixes
goes beyond its run, and equal runs need no deep sorting.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    stops = symbols == 0
    count = int(stops.sum())
    first = np.where(stops, np.cumsum(stops) - 1, symbols.astype(np.int64) + count - 1)
    base = int(first.max(initial=0)) + 1
    ahead = lambda k: np.concatenate([first[k:], np.zeros(min(k, n), np.int64)])
    # As many symbols as fit one number make the first key.
    key, depth = first.copy(), 1
    while depth < 4 and base ** (depth + 1) < 1 << 62:
        key = key * base + ahead(depth)
        depth += 1
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    ranked = key[order]
    while True:
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(head, slots, 0))
        tied = ~(head & np.concatenate([head[1:], [True]]))
        slots = slots[tied]
        if not len(slots):
            return order
        own = order[slots]
        key = rank[own] * n + rank[np.minimum(own + depth, n - 1)]
        inside = np.argsort(key, kind="stable")
        order[slots] = own[inside]
        ranked = key[inside]
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols: per bit, from the highest, the ones before each place."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, top.bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (values >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])
        self.first = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, level in enumerate(reversed(range(self.bits))):
            before = self.ones[depth][at]
            at = np.where(symbols >> level & 1, self.zeros[depth] + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places, and how often each occurs before its place."""
        symbols = np.zeros(len(at), np.int64)
        for depth in range(self.bits):
            before = self.ones[depth][at]
            bit = self.ones[depth][at + 1] > before
            symbols = symbols << 1 | bit
            at = np.where(bit, self.zeros[depth] + before, at - before)
        return symbols, at - self.first[symbols]


class FmIndex:
    """Counts and places of patterns of positive symbols."""

    def __init__(self, symbols: np.ndarray, top: int, every: int = 8):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.tree = WaveletMatrix(np.where(order > 0, symbols[order - 1], 0).astype(np.int64), top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        # Suffix positions are kept for every few places, and where a run begins.
        sampled = (order % every == 0) | (order == 0) | (symbols[order - 1] == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern, found from its end."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        step = 0
        live = np.flatnonzero(lengths > 0)
        while len(live):
            own = patterns[live, lengths[live] - 1 - step]
            low[live] = self.before[own] + self.tree.rank(own, low[live])
            high[live] = self.before[own] + self.tree.rank(own, high[live])
            step += 1
            live = live[(low[live] < high[live]) & (lengths[live] > step)]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: step back through the text to a row whose place is kept."""
        out = np.zeros(len(rows), np.int64)
        walking, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(walking):
            known = self.sampled[at + 1] > self.sampled[at]
            out[walking[known]] = self.places[self.sampled[at[known]]] + steps
            walking, at = walking[~known], at[~known]
            symbols, before = self.tree.access(at)
            at = self.before[symbols] + before
            steps += 1
        return out


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and which range each comes from."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner
