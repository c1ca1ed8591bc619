"""Elias-Fano sequences over numpy arrays, which may be memory-mapped.

A sorted sequence of n values is kept as low bits, packed, and high bits, in unary: a one for each value and a zero
where the high part grows by one. Values are read by their place and found by value without unpacking the sequence;
both work on arrays of queries.
"""

from __future__ import annotations

import numpy as np

#: Bits of one block of the directory.
WORD = 128
#: Queries answered at once, and values for each query up to which a sequence is read whole.
CHUNK, DENSE = 1 << 15, 16
#: Ones in a byte, and the place of its r-th one.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
ONES = _BITS.sum(axis=1, dtype=np.uint8)
PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits one after another in 64-bit words, with a spare word at the end."""
    out = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        if len(values):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = shift + np.uint64(bits) > 64
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])  # at most one value reaches into each word
    return out


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a sorted sequence of unsigned 64-bit integers."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64)
    size = n + (top >> low) + 2
    bits = np.zeros(-(-size // WORD) * WORD, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    zeros = WORD - bits.reshape(-1, WORD).sum(axis=1, dtype=np.int64)
    return {
        "meta": np.array([n, low, size], dtype=np.int64),
        "low": _pack(values & np.uint64((1 << low) - 1), low),
        "high": np.packbits(bits, bitorder="little"),
        "zeros": np.concatenate([[0], np.cumsum(zeros)]).astype(np.uint32 if size < 1 << 32 else np.uint64),
    }


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.size = (int(x) for x in arrays["meta"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.ones = np.arange(len(self.zeros), dtype=np.int64) * WORD - self.zeros.astype(np.int64)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = self.low[word] >> shift
        spare = (np.uint64(64) - shift) & np.uint64(63)
        second = np.where(shift > 0, self.low[word + 1] << spare, np.uint64(0))
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def _select(self, rank: np.ndarray, directory: np.ndarray, bit: int) -> np.ndarray:
        """Place of the rank-th (from 0) bit of this kind."""
        block = np.searchsorted(directory, rank, side="right") - 1
        inside = rank - directory[block].astype(np.int64)
        rows = self.high.reshape(-1, WORD // 8)[block]
        if not bit:
            rows = ~rows
        upto = np.cumsum(ONES[rows], axis=1, dtype=np.uint8)
        byte = (upto <= inside[:, None]).sum(axis=1)
        each = np.arange(len(rank))
        before = np.where(byte > 0, upto[each, byte - 1], 0)
        return block * WORD + byte * 8 + PLACE[rows[each, byte], inside - before]

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at these places."""
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(0, len(at), CHUNK):
            a = at[k : k + CHUNK]
            high = self._select(a, self.ones, 1) - a
            out[k : k + CHUNK] = (high.astype(np.uint64) << np.uint64(self.bits)) | self._lows(a)
        return out

    def values(self) -> np.ndarray:
        """The whole sequence."""
        at = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.high, count=self.size, bitorder="little")) - at
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of these values; -1 for those that the sequence doesn't hold. Many queries are answered by one pass over it."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n:
            return out
        if DENSE * len(values) >= self.n:
            whole, v = self.values(), values.astype(np.uint64)
            at = np.minimum(np.searchsorted(whole, v), self.n - 1)
            return np.where(whole[at] == v, at, -1)
        for k in range(0, len(values), CHUNK):
            v = values[k : k + CHUNK].astype(np.uint64)
            high = (v >> np.uint64(self.bits)).astype(np.int64)
            low = v & np.uint64((1 << self.bits) - 1)
            live = np.flatnonzero(high + self.n < self.size)
            high, low = high[live], low[live]
            # the ones between the high-th zero and the next hold the values with this high part
            first = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, 0) + 1, 0) - high
            end = self._select(high, self.zeros, 0) - high
            lo, hi = first.copy(), end.copy()
            todo = np.flatnonzero(lo < hi)
            while len(todo):
                middle = (lo[todo] + hi[todo]) >> 1
                less = self._lows(middle) < low[todo]
                lo[todo[less]] = middle[less] + 1
                hi[todo[~less]] = middle[~less]
                todo = todo[lo[todo] < hi[todo]]
            inside = np.flatnonzero(lo < end)
            found = np.full(len(live), -1, dtype=np.int64)
            hit = inside[self._lows(lo[inside]) == low[inside]]
            found[hit] = lo[hit]
            out[k + live] = found
        return out
