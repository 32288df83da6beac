"""An FM-index over symbols in numpy: ranks by wavelet tree, places by sampled suffixes."""

from __future__ import annotations

import numpy as np


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """The sorted suffixes of ``ranks``; its last value must occur once.

    Prefix doubling: each round sorts only the suffixes that still tie, by what follows the
    part that is sorted already.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    begins = np.r_[True, ranks[order][1:] != ranks[order][:-1]]
    sizes = np.diff(np.r_[np.flatnonzero(begins), n])
    place = np.empty(n, np.int64)
    place[order] = np.repeat(np.flatnonzero(begins), sizes)
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    done = 1
    while len(tied):
        at = order[tied]
        key = place[at] * n + place[at + done]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[tied] = at
        begins = np.r_[True, key[1:] != key[:-1]]
        sizes = np.diff(np.r_[np.flatnonzero(begins), len(key)])
        place[at] = np.repeat(tied[begins], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        done *= 2
    return order


class WaveletTree:
    """Ranks of symbols, level by level from the highest bit, each level one row of counts."""

    def __init__(self, symbols: np.ndarray, highest: int):
        self.bits = max(1, int(highest).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~ones)].astype(np.int32))
            symbols = np.r_[symbols[~ones], symbols[ones]]

    def _down(self, level: int, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        zeros = self.zeros[level]
        left = zeros[at]
        return np.where(ones, zeros[-1] + at - left, left)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for level in range(self.bits):
            ones = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            start, at = self._down(level, ones, start), self._down(level, ones, at)
        return at - start

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros_like(place)
        for level in range(self.bits):
            ones = self.zeros[level][place + 1] == self.zeros[level][place]
            symbol = symbol << 1 | ones
            place = self._down(level, ones, place)
        return symbol


class FMIndex:
    """Finds words of positive symbols in a text whose stretches each end with a zero.

    The zeros differ from each other, earlier ones being smaller, so no match crosses one.
    """

    def __init__(self, text: np.ndarray, highest: int, every: int = 16):
        stops = text == 0
        ranks = np.where(stops, np.cumsum(stops) - 1, int(stops.sum()) - 1 + text)
        order = suffix_order(ranks)
        before = text[order - 1]
        self.size = len(text)
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=highest + 1))]
        self.tree = WaveletTree(before, highest)
        # A walk back ends at a sampled place; the first of a stretch always is one.
        self.sampled = (order % every == 0) | (before == 0)
        self.samples = order[self.sampled]
        self.number = np.r_[0, np.cumsum(self.sampled)]

    def search(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all ``words`` (rows, padded) at once: their ranges of suffixes."""
        low = np.zeros(len(words), np.int64)
        high = np.where((words < 0).any(axis=1), 0, self.size)
        for step in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((sizes > step) & (high > low))
            symbol = words[live, sizes[live] - 1 - step]
            base = self.below[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes given by their ranks."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            found = self.sampled[at]
            out[left[found]] = self.samples[self.number[at[found]]] + steps
            left, at = left[~found], at[~found]
            symbol = self.tree.at(at)
            at = self.below[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
