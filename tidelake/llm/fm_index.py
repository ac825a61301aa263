"""An FM-index over one shard of symbols, in numpy: suffix array by prefix
doubling, wavelet-matrix ranks over the Burrows-Wheeler transform, backward
search of many patterns at once, and occurrences from sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``keys`` (any integers), a suffix that ends earlier first."""
    n = len(keys)
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - step, 0)] = rank[step:]
        joint = rank * (n + 2) + ahead
        order = np.argsort(joint, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], joint[order][1:] != joint[order][:-1]]))
        rank = fresh
        if step >= n or rank[order[-1]] == n:
            return order
        step *= 2


class WaveletMatrix:
    """Counts of a symbol in any prefix of ``values`` (0 <= value < 2**bits)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``lo`` and before ``hi``, both less an offset shared by the two; see ``start``."""
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo, hi

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the given places, and the place of each in the sorted order of the last level."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[at]
            bit = ones[at + 1] - a
            symbols = symbols * 2 + bit
            at = np.where(bit == 1, zeros + a, at - a)
        return symbols, at


class FMIndex:
    """Index of runs of symbols 1, 2, ...; ``starts`` are where runs begin in ``symbols``.  No match crosses runs."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, alphabet: int, sample: int = 8):
        runs, n = len(starts), len(symbols)
        # Each run ends with a separator of its own, smaller than any symbol.
        lengths = np.diff(np.append(starts, n))
        place = np.arange(n) + np.repeat(np.arange(runs), lengths)
        text = np.zeros(n + runs, np.int64)
        text[place] = symbols
        apart = np.flatnonzero(text == 0)
        keys = text.copy()
        keys[apart] = -np.arange(1, runs + 1)
        self.size = n + runs
        self.origin = np.full(self.size, -1)
        self.origin[place] = np.arange(n)
        order = suffix_array(keys)
        before = text[order - 1]  # the first suffix wraps to the last separator
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.ranks = WaveletMatrix(before, max(int(alphabet).bit_length(), 1))
        # Position of each symbol's block at the last level, to turn places there into ranks.
        every = np.arange(alphabet + 1)
        self.base = self.ranks.rank(every, np.zeros_like(every), np.zeros_like(every))[0]
        kept = order % sample == 0
        kept |= np.isin(order, place[starts] if runs else [])  # so no walk leaves its run
        self.known = np.where(kept, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the rows of ``patterns`` (all of one length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        alive = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[alive, k]
            a, b = self.ranks.rank(c, lo[alive], hi[alive])
            lo[alive], hi[alive] = self.counts[c] + a - self.base[c], self.counts[c] + b - self.base[c]
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in ``symbols`` the suffixes of these rows begin."""
        out, steps = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        at = rows.copy()
        while len(open_):
            known = self.known[at]
            done = known >= 0
            out[open_[done]] = known[done] + steps[open_[done]]
            open_, at = open_[~done], at[~done]
            if len(open_):
                c, place = self.ranks.get(at)
                at = self.counts[c] + place - self.base[c]
                steps[open_] += 1
        return self.origin[out]
