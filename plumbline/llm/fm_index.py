"""A compressed FM-index over word symbols: wavelet levels of packed bits, backward search in batches."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class Wavelet:
    """A wavelet matrix: one level of bits per bit of a symbol, the highest first."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(width - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits), int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``low`` and before ``high``."""
        base = np.zeros(len(symbols), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbols >> shift & 1).astype(bool)
            b, l, h = bits.rank(base), bits.rank(low), bits.rank(high)
            base = np.where(one, zeros + b, base - b)
            low = np.where(one, zeros + l, low - l)
            high = np.where(one, zeros + h, high - h)
        return low - base, high - base


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by what follows them, over at least ``depth`` symbols; equal ones by place."""
    n = len(symbols)
    rank, reach = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reach < depth and n:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        reach *= 2
    return order


class FMIndex:
    """Texts of word symbols, each followed by a separator, with the owner of each text.

    Backward search needs suffixes in the order of as many symbols as a pattern
    has, so ``depth`` bounds the patterns.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        """``symbols`` are 1 and up; 0 separates."""
        width = max(1, int(symbols.max(initial=0)).bit_length())
        self.order = suffix_order(symbols, depth + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << width))])
        self.last = Wavelet(symbols[self.order - 1], width)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes after one more symbol in front of each pattern."""
        a, b = self.last.ranks(symbols, low, high)
        start = self.first[symbols]
        return start + a, start + b


class Minima:
    """Smallest value of any interval, from tables of intervals of powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        step = 1
        while 2 * step <= len(values):
            above = self.tables[-1]
            self.tables.append(np.minimum(above[:-step], above[step:]))
            step *= 2

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over ``[low, high)``, which must not be empty."""
        out = np.empty(len(low), dtype=self.tables[0].dtype)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            table = self.tables[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def matching_owners(index: FMIndex, lowest: Minima, symbols: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For patterns of ``window`` symbols that end at ``ends``: how far each matches elsewhere, and its first owner.

    The patterns stream backwards through the index together.  One drops out as
    soon as a single suffix is left, for that is its own: its matching length
    is then what more than one text shared.  Where the length reaches the
    window, the owner is the lowest of all texts that hold the pattern.
    """
    lengths = np.zeros(len(ends), dtype=np.int64)
    owners = np.full(len(ends), -1, dtype=np.int64)
    active = np.arange(len(ends))
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(symbols), np.int64)
    for step in range(window):
        low, high = index.extend(symbols[ends[active] - step], low, high)
        shared = high - low > 1
        active, low, high = active[shared], low[shared], high[shared]
        lengths[active] = step + 1
        if not len(active):
            return lengths, owners
    owners[active] = lowest.over(low, high)
    return lengths, owners
