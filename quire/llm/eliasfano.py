"""Elias-Fano sequences: monotone integers in low bits and a unary high part, searched many at a time.

A value's low bits are stored packed; its high part h sets bit h + i for the i-th value. The values with one
high part lie between two zeros of that bit vector, so a successor search is one select on zeros and a
short binary search among low bits. Arrays are little-endian and can be views of a memory-mapped file.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_BYTES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: position of the r-th set bit (from 0) of a byte
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


def encode(values: np.ndarray, universe: int) -> bytes:
    """values: non-decreasing, each below universe."""
    v = values.astype(_U)
    n = len(v)
    bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    high = v >> _U(bits)
    flags = np.zeros((n + (universe >> bits) + 64) // 64 * 64 + 64, bool)
    flags[high.astype(np.int64) + np.arange(n)] = True
    upper = np.packbits(flags, bitorder="little").view("<u8")
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))[:-1]]).astype("<u8")
    lower = np.zeros(n * bits // 64 + 2, _U)
    if bits:
        at = np.arange(n, dtype=_U) * _U(bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        low = v & _U((1 << bits) - 1)
        np.bitwise_or.at(lower, word, low << shift)
        over = shift + _U(bits) > 64
        np.bitwise_or.at(lower, word[over] + 1, low[over] >> (_U(64) - shift[over]))
    return struct.pack("<4Q", n, bits, len(upper), len(lower)) + upper.tobytes() + zeros.tobytes() + lower.astype("<u8").tobytes()


class Sequence:
    """A sequence of encode(), over a buffer that starts with it."""

    def __init__(self, data: np.ndarray):
        self.n, self.bits, nu, nl = (int(x) for x in data[:32].view("<u8"))
        self.upper, self.zeros, self.lower = (data[a : a + 8 * n].view("<u8") for a, n in ((32, nu), (32 + 8 * nu, nu), (32 + 16 * nu, nl)))
        self.size = 32 + 16 * nu + 8 * nl

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        up = np.where(shift > 0, self.lower[word + 1] << (_U(64) - shift) % _U(64), _U(0))
        return (self.lower[word] >> shift | up) & _U((1 << self.bits) - 1)

    @staticmethod
    def _select(words: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The place of each word's left-th set bit (from 0), by sums of bytes inside the word."""
        x = words - (words >> _U(1) & _U(0x5555555555555555))
        x = (x & _U(0x3333333333333333)) + (x >> _U(2) & _U(0x3333333333333333))
        upto = (x + (x >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES  # byte i: set bits of bytes 0 to i
        left = left.astype(_U)
        shift = np.bitwise_count((left * _BYTES | _TOPS) - upto & _TOPS).astype(_U) << _U(3)
        before = (upto << _U(8)) >> shift & _U(255)
        return shift.astype(np.int64) + _SELECT[(words >> shift & _U(255)).astype(np.int64), (left - before).astype(np.int64)]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th zeros (from 0) of the high part."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + self._select(~self.upper[word], k - self.zeros[word])

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with each high part begin and end."""
        end = self._zero(high) - high.astype(np.int64)
        return np.where(high > 0, self._zero(np.maximum(high, _U(1)) - _U(1)) - high.astype(np.int64) + 1, 0), end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the index of the first value that is not smaller (n if there is none). Sorted x are fastest."""
        x = x.astype(_U)
        return self._within(*self._bucket(x >> _U(self.bits)), x & _U((1 << self.bits) - 1))

    def _within(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        ones = np.arange(1, len(self.zeros) + 1) * 64 - np.append(self.zeros[1:], self.zeros[-1] + _U(64) - _U(np.bitwise_count(self.upper[-1]))).astype(np.int64)
        word = np.searchsorted(ones, i, "right")
        position = word * 64 + self._select(self.upper[word], i - (word * 64 - self.zeros[word].astype(np.int64)))
        return (position - i).astype(_U) << _U(self.bits) | self._low(i)

    def find(self, x: np.ndarray, universe: int) -> np.ndarray:
        """The index of each x, -1 where it is absent or not below universe. The first of equal values."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        within = x.astype(_U) < _U(universe)
        y = np.where(within, x, 0).astype(_U)
        high, low = y >> _U(self.bits), y & _U((1 << self.bits) - 1)
        start, end = self._bucket(high)
        i = self._within(start, end, low)
        at = np.minimum(i, self.n - 1)
        same = (i < self.n) & within & (self._low(at) == low)
        # Inside its own bucket an index has its own high part, so equal low bits mean an equal value.
        return np.where(same & (i < end), i, -1)
