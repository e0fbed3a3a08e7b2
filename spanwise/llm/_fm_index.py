"""FM-index of an integer sequence: wavelet matrix ranks, sampled suffix positions, batched search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """Bit vector with constant-time rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(np.concatenate([bits.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE != 0


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; symbols are at least 1, the end sorts first."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while True:
        key = rank * np.int64(n + 2)
        key[: n - step if n > step else 0] += rank[step:]
        order = np.argsort(key, kind="stable")
        change = np.ones(n, np.int64)
        change[1:] = key[order][1:] != key[order][:-1]
        new = np.cumsum(change)
        rank[order] = new
        if not n or new[-1] == n:
            return order
        step *= 2


class FMIndex:
    """Backward search over a sequence of symbols >= 1; every ``sample``-th suffix position is kept."""

    def __init__(self, seq: np.ndarray, sample: int = 16) -> None:
        seq = np.concatenate([seq.astype(np.int64), [0]])
        self.n = n = len(seq)
        order = suffix_array(seq + 1)
        bwt = seq[order - 1]
        top = int(seq.max())
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=top + 1), out=self.first[1:])
        self.top = top
        self.levels: list[Bits] = []
        part = bwt
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (part >> level) & 1
            self.levels.append(Bits(bit))
            part = np.concatenate([part[bit == 0], part[bit == 1]])
        kept = order % sample == 0
        self.kept, self.samples = Bits(kept), order[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position of the transform."""
        low, high = np.zeros_like(at), at
        depth = len(self.levels)
        for k, bits in enumerate(self.levels):
            one = (symbol >> (depth - 1 - k)) & 1 != 0
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, bits.zeros + a, low - a), np.where(one, bits.zeros + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bits in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            out = out * 2 + one
            at = np.where(one, bits.zeros + ones, at - ones)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals [low, high) of suffixes that begin with each phrase, a row of equal length each."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        live = np.flatnonzero(phrases.max(axis=1) <= self.top) if len(phrases) else np.empty(0, np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            on = lo < hi
            live, lo, hi = live[on], lo[on], hi[on]
            if not len(live):
                break
        low[live], high[live] = lo, hi
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes, by steps to the next sampled one."""
        out, steps, todo = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        at = at.astype(np.int64)
        while len(todo):
            hit = self.kept.get(at)
            out[todo[hit]] = self.samples[self.kept.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.symbol(at)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out
