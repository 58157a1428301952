"""Elias-Fano coded rising numbers in flat arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers.

    The lower ``low`` bits of each number are packed one after the other in 64-bit words; the upper parts are a bit
    vector in which the i-th number sets bit (upper part + i).
    """

    FIELDS = ("lows", "highs")

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        self._upper: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Codes sorted ``values`` below ``universe``."""
        n = len(values)
        values = values.astype(np.uint64)
        low = max(0, min(56, (max(1, universe // max(1, n))).bit_length() - 1))
        upper = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros((int(upper[-1]) if n else 0) + n + 1, bool)
        bits[upper + np.arange(n)] = True
        lows = np.zeros((n * low >> 6) + 2, np.uint64)
        if low and n:
            part = values & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.int64) * low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lows[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift > np.uint64(64 - low))
            lows[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        return cls(n, low, lows, np.packbits(bits, bitorder="little"))

    def _uppers(self) -> np.ndarray:
        if self._upper is None:
            ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
            self._upper = (ones - np.arange(self.n)).astype(np.uint64)
        return self._upper

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        out = self._uppers()[i]
        if not self.low:
            return out
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.lows[word] >> shift
        # A shift by 64 isn't defined, so the next word's bits move in two steps.
        part |= (self.lows[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (out << np.uint64(self.low)) | (part & np.uint64((1 << self.low) - 1))

    def decode(self) -> np.ndarray:
        """All numbers."""
        return self.get(np.arange(self.n, dtype=np.int64))

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each number of ``x`` in a sequence of different numbers, -1 where it isn't."""
        return self.search(x.astype(np.uint64), np.zeros(len(x), np.int64), np.full(len(x), self.n, np.int64))

    def search(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each number of ``x`` among those from ``first`` to before ``end``, -1 where it isn't there."""
        out = np.full(len(x), -1, np.int64)
        on = np.flatnonzero(first < end)
        a, b, want = first[on], end[on], x[on]
        while len(on):
            i = (a + b) >> 1
            got = self.get(i)
            hit = got == want
            out[on[hit]] = i[hit]
            less = got < want
            a, b = np.where(less, i + 1, a), np.where(less, b, i)
            left = ~hit & (a < b)
            on, a, b, want = on[left], a[left], b[left], want[left]
        return out
