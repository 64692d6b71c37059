"""Elias-Fano sequences over memory-mapped bytes, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.int64)
_SELECT = np.full((256, 8), 8, np.int64)  # place of the k-th one of a byte
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _k] = _p
_FLIPPED = _SELECT[255 - np.arange(256)]


def pack_monotone(values: np.ndarray, universe: int) -> bytes:
    """A non-decreasing sequence below ``universe``: low bits verbatim, high bits in unary, counts of ones by 64 bits."""
    n = len(values)
    values = values.astype(np.uint64)
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    words = (int(high[-1]) + 1 if n else 0) // 64 + 2
    bits = np.zeros(words * 64, np.uint8)
    bits[high] = 1
    packed = np.packbits(bits, bitorder="little")
    ones = np.concatenate([[0], np.cumsum(_POP[packed].reshape(-1, 8).sum(1))]).astype(np.int64)
    low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
    if low_bits and n:
        rest = values & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, rest << off)
        over = (off + np.uint64(low_bits)) > np.uint64(64)
        np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - off[over]))
    head = np.array([n, low_bits, len(packed), len(ones), len(low)], np.int64)
    return head.tobytes() + ones.tobytes() + low.tobytes() + packed.tobytes()


class Monotone:
    """Reads what :func:`pack_monotone` wrote; ``end`` is the place after it."""

    def __init__(self, data: np.ndarray, at: int = 0):
        self.n, self.low_bits, packed, ones, low = data[at : at + 40].view(np.int64).tolist()
        at += 40
        self.ones = data[at : at + 8 * ones].view(np.int64)
        at += 8 * ones
        self.low = data[at : at + 8 * low].view(np.uint64)
        at += 8 * low
        self.high = data[at : at + packed]
        self.end = at + packed

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one, or zero, of the high bits."""
        if one:
            counts = self.ones
            word = np.searchsorted(counts, k, "right") - 1
            left = k - counts[word]
        else:
            if not hasattr(self, "zeros"):
                self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones
            word = np.searchsorted(self.zeros, k, "right") - 1
            left = k - self.zeros[word]
        inside = self.high[(word * 8)[:, None] + np.arange(8)]
        pops = _POP[inside] if one else 8 - _POP[inside]
        sums = np.cumsum(pops, 1)
        byte = (sums <= left[:, None]).sum(1)
        each = np.arange(len(k))
        left = left - np.where(byte > 0, sums[each, byte - 1], 0)
        return word * 64 + byte * 8 + (_SELECT if one else _FLIPPED)[inside[each, byte], left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> off
        over = off + np.uint64(self.low_bits) > np.uint64(64)
        if over.any():
            out = out.copy()
            out[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.uint64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, -1 where the sequence lacks it: its high bits give a run, searched by the low bits.

        With ``first`` and ``end``, only places from the one up to the other are searched for each value.
        """
        out = np.full(len(values), -1, np.int64)
        if not len(values) or not self.n:
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = 64 * (len(self.ones) - 1) - int(self.ones[-1])
        inside = np.flatnonzero(high < zeros)
        high, want = high[inside], values[inside] & np.uint64((1 << self.low_bits) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        hi = self._select(high, False) - high
        lo, hi = lo.copy(), np.minimum(hi, self.n)
        if first is not None:
            lo, hi = np.maximum(lo, first[inside]), np.minimum(hi, end[inside])
        top = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            middle = (lo[live] + hi[live]) >> 1
            less = self._low(middle) < want[live]
            lo[live] = np.where(less, middle + 1, lo[live])
            hi[live] = np.where(less, hi[live], middle)
            live = live[lo[live] < hi[live]]
        found = np.flatnonzero(lo < top)
        good = found[self._low(lo[found]) == want[found]]
        out[inside[good]] = lo[good]
        return out
