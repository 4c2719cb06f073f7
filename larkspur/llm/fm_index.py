"""FM-index over a sequence of word numbers, in numpy.

``0`` separates texts.  The suffix order comes from rank doubling, the ranks of
the Burrows-Wheeler transform from a wavelet matrix with running counts, and
positions from suffixes sampled at every ``SAMPLE``-th place of the sequence.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the length by which suffixes are ranked."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    order, step = np.argsort(rank, kind="stable"), 1
    while n and step < n:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class WaveletMatrix:
    """rank(c, i): how often ``c`` occurs among the first i symbols; access(i)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        x = symbols
        for b in range(bits - 1, -1, -1):
            bit = x >> b & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (c >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = ones[start], ones[end]
            start = np.where(bit, zeros + a, start - a)
            end = np.where(bit, zeros + b, end - b)
        return end - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    def __init__(self, sequence: np.ndarray):
        """``sequence`` holds numbers from 0; a terminator below all is added here."""
        s = np.concatenate([sequence.astype(np.int64) + 1, [0]])
        order = suffix_order(s)
        bwt = s[order - 1]
        size = int(s.max()) + 1
        self.n = len(s)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
        self.matrix = WaveletMatrix(bwt, max(1, (size - 1).bit_length()))
        self.size = size
        self.sampled = np.where(order % SAMPLE == 0, order, -1)

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of patterns (rows, padded at the end) by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1]):
            at = lengths - 1 - k
            on = (at >= 0) & (low < high)
            c = np.where(on, patterns[np.arange(len(patterns)), np.maximum(at, 0)] + 1, 0)
            known = c < self.size
            c = np.where(known, c, 0)
            new_low = self.before[c] + self.matrix.rank(c, low)
            new_high = self.before[c] + self.matrix.rank(c, high)
            low, high = np.where(on, np.where(known, new_low, 0), low), np.where(on, np.where(known, new_high, 0), high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-array rows: walk back to the nearest sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.sampled[rows] < 0)
        while len(open_):
            c = self.matrix.access(rows[open_])
            rows[open_] = self.before[c] + self.matrix.rank(c, rows[open_])
            steps[open_] += 1
            open_ = open_[self.sampled[rows[open_]] < 0]
        return self.sampled[rows] + steps
