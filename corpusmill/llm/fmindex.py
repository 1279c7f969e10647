"""FM-index over a sequence of small integers: suffix array by prefix doubling, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; a suffix that is a prefix of another comes first."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        fresh = np.append(0, np.cumsum(in_order[1:] != in_order[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over a sequence, one bit level after the other, most significant first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int64))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, sym: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often sym stands before position end."""
        lo, hi = np.zeros_like(end), end.copy()
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[k], ((sym >> level) & 1).astype(bool)
            lo = np.where(one, self.zeros[k] + ones[lo], lo - ones[lo])
            hi = np.where(one, self.zeros[k] + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            ones = self.ones[k]
            one = (ones[at + 1] - ones[at]).astype(bool)
            out = (out << 1) | one
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and location. Symbols are at least 1; 0 ends the sequence."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(seq[order - 1], max(1, int(seq.max()).bit_length()))
        self.first = np.append(0, np.cumsum(np.bincount(seq)))
        self.marked = order % sample == 0
        self.sampled = order[self.marked]
        self.mark_rank = np.append(0, np.cumsum(self.marked))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of patterns of one length, one pattern a row; empty where there is none."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for col in range(patterns.shape[1] - 1, -1, -1):
            sym = patterns[:, col].astype(np.int64)
            there = (sym + 1 < len(self.first)) & (hi > lo)
            sym = np.where(there, sym, 0)
            lo = np.where(there, self.first[sym] + self.bwt.rank(sym, lo), 0)
            hi = np.where(there, self.first[sym] + self.bwt.rank(sym, hi), 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the index: walks back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked[rows[todo]]
            at = todo[done]
            out[at] = self.sampled[self.mark_rank[rows[at]]] + steps[at]
            todo = todo[~done]
            sym = self.bwt.access(rows[todo])
            rows[todo] = self.first[sym] + self.bwt.rank(sym, rows[todo])
            steps[todo] += 1
        return out
