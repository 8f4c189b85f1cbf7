"""Compressed full-text index over word numbers: wavelet matrix of the Burrows-Wheeler transform, searched by many cursors at once."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Rank over a sequence of numbers: one packed bit row with block counts per bit of the alphabet."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels, n = [], len(values)
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.zeros((n >> 6) + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((bit, packed, before.astype(np.int64), int(n - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` entries end among those of a symbol, plus the symbol's start."""
        for bit, packed, before, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` symbols at least, by doubling."""
    rank, width = text.astype(np.int64), 1
    while width < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]
        width *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Index of a sequence of symbols from 0; finds patterns of up to ``depth`` - 1 symbols, since suffixes are sorted that deep."""

    def __init__(self, text: np.ndarray, depth: int = 16):
        self.order = suffix_order(text, depth)
        self.top = int(text.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self.wavelet = Wavelet(text[self.order - 1], self.top)
        every = np.arange(self.top + 1)
        self.start = self.wavelet.path(every, np.zeros(len(every), np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with one more symbol on the left."""
        move = self.first[symbol] - self.start[symbol]
        return move + self.wavelet.path(symbol, low), move + self.wavelet.path(symbol, high)

    def statistics(self, text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per end position: length of the longest match that ends there (up to ``longest``) and its range."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.order), np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(longest):
            at = ends[live] - 1 - step
            live, at = live[at >= 0], at[at >= 0]
            symbol = text[at]
            known = (symbol >= 0) & (symbol <= self.top)
            live, symbol = live[known], symbol[known]
            if not len(live):
                break
            a, b = self.extend(symbol, low[live], high[live])
            go = b > a
            live = live[go]
            low[live], high[live], length[live] = a[go], b[go], step + 1
        return length, low, high


def smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values`` over ranges that are equal or disjoint."""
    start, back = np.unique(low, return_inverse=True)
    end = np.zeros(len(start), np.int64)
    end[back] = high
    cuts = np.stack([start, end], axis=1).ravel()
    padded = np.append(values, np.iinfo(values.dtype).max)
    return np.minimum.reduceat(padded, cuts)[::2][back]
