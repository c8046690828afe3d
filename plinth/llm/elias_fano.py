"""Elias-Fano sequences in numpy: sorted integers as low bits and unary high bits, queried many at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64


BYTES, TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: [byte, r]: the place of the byte's r-th set bit.
SELECT = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8).ravel()


def _in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th (from 0) set bit of each word: the byte by prefix sums of bits in bytes, then a table."""
    s = w - ((w >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * BYTES  # byte k: set bits of bytes 0 to k
    r = r.astype(U)
    shift = np.bitwise_count((((r * BYTES) | TOPS) - s) & TOPS).astype(U) << U(3)  # bytes that end before: sums of at most r
    before = (s << U(8)) >> shift & U(255)
    return (shift + SELECT[((((w >> shift) & U(255)) << U(3)) + r - before).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """n sorted values below ``universe``; arrays: what has to be stored. The directories are small next to them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        top = int(values[-1] >> U(low_bits)) if n else 0
        high = np.zeros(((n + top + 1) // 64 + 1) * 64, np.uint8)
        high[((values >> U(low_bits)) + np.arange(n, dtype=U)).astype(np.int64)] = 1
        high = np.packbits(high, bitorder="little").view("<u8")
        low = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits:
            bit = np.arange(n, dtype=U) * U(low_bits)
            word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
            part = values & U((1 << low_bits) - 1)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first) if n else U(0)
            spill = np.flatnonzero(shift + U(low_bits) > U(64))  # at most one from a word
            low[word[spill] + 1] |= part[spill] >> (U(64) - shift[spill])
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, low_bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.low_bits)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        out = self.low[word] >> shift
        spill = shift + U(self.low_bits) > U(64)
        out[spill] |= self.low[word[spill] + 1] << (U(64) - shift[spill])
        return out & U((1 << self.low_bits) - 1)

    def _set(self, bit: int) -> np.ndarray:
        """The places of all ones or zeros among the high bits: for so many questions that this costs less than a search for each."""
        return np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == bit)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        if len(i) * 8 > self.n:
            return ((self._set(1)[i] - i).astype(U) << U(self.low_bits)) | self._low(i)
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = word * 64 + _in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(U) << U(self.low_bits)) | self._low(i)

    def _buckets(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of values whose high part is h: between the ones before zero h - 1 and those before zero h."""
        if len(h) * 8 > self.n:
            zeros = self._set(0) - np.arange(len(self.high) * 64 - int(self.ones[-1]))
            return np.where(h <= 0, 0, np.minimum(zeros[np.maximum(h - 1, 0)], self.n)), np.minimum(zeros[h], self.n)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        last = len(self.high) - 1
        r = np.maximum(h - 1, 0)
        word = np.minimum(np.searchsorted(zeros, r, side="right") - 1, last)
        at = word * 64 + _in_word(~self.high[word], r - zeros[word]) + 1  # just after zero h - 1
        a = np.where(h <= 0, 0, np.minimum(at - h, self.n))
        at = np.where(h <= 0, 0, at)
        word, bit = np.minimum(at >> 6, last), (at & 63).astype(U)
        x = self.high[word] >> bit
        run = np.bitwise_count((x ^ (x + U(1))) >> U(1)).astype(np.int64)  # ones from there on
        run[x == ~U(0)] = 64
        b = np.minimum(a + run, self.n)
        on = np.flatnonzero(run + (at & 63) >= 64)
        while len(on):  # ones up to the end of a word go on in the next
            word[on] += 1
            on = on[word[on] <= last]
            x = self.high[word[on]]
            more = np.bitwise_count((x ^ (x + U(1))) >> U(1)).astype(np.int64)
            more[x == ~U(0)] = 64
            b[on] = np.minimum(b[on] + more, self.n)
            on = on[more == 64]
        return a, b

    def _search(self, x: np.ndarray, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first place in [begin, end) with a value of at least x, else end; and the end of the values with its high part."""
        end = np.full(len(x), self.n, np.int64) if end is None else np.broadcast_to(end, x.shape).astype(np.int64)
        top = self.ones[-1] and int(len(self.high) * 64 - self.ones[-1]) - 1
        high = x >> U(self.low_bits)
        over = high > U(max(0, top))
        a, b = self._buckets(np.minimum(high, U(max(0, top))).astype(np.int64))
        a = np.clip(a, begin, end)
        b = np.clip(b, a, end)
        if over.any():
            a[over] = b[over] = end[over]
        low = x & U((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(x), U)
        stop = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):  # binary search in what shares the high part
            mid = (a[live] + b[live]) // 2
            less = self._low(mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        return a, stop

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """For each x the first place in [begin, end) with a value of at least x, else end."""
        return self._search(x.astype(U), begin, end)[0]

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each x in [begin, end), or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(U)
        at, stop = self._search(x, begin, end)
        ok = np.flatnonzero(at < stop)  # a successor with the same high part
        out = np.full(len(x), -1, np.int64)
        same = ok[self._low(at[ok]) == (x[ok] & U((1 << self.low_bits) - 1))]
        out[same] = at[same]
        return out
