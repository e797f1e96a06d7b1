"""Elias-Fano sequences and an n-gram trie of two levels over them, on memory-mapped arrays.

All lookups take arrays of queries.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

U = np.uint64
_ONE = U(1)


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, end to end in 64-bit words (and one spare word)."""
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 1, U)
    if not bits or not n:
        return out
    low = values & U((1 << bits) - 1)
    at = np.arange(n, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(U)
    np.bitwise_or.at(out, word, low << shift) if n < 64 else _or_sorted(out, word, low << shift)
    over = (at & 63) + bits > 64
    if over.any():
        _or_sorted(out, word[over] + 1, low[over] >> (U(64) - shift[over]))
    return out


def _or_sorted(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] |= np.bitwise_or.reduceat(bits, first)


def _select_in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each word."""
    at = np.zeros(len(w), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(w & U((1 << s) - 1)).astype(np.int64)
        up = r >= c
        at += up * s
        r = r - up * c
        w = np.where(up, w >> U(s), w)
    return at


class EliasFano:
    """A sequence of values that never falls.  Parts: low bits packed; high bits in unary, with running counts a word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        place = (values >> U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, U)
        if n:
            _or_sorted(high, place >> 6, _ONE << (place & 63).astype(U))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high)))).astype(np.uint32 if n < 2**32 else np.uint64)
        return cls(n, bits, _pack_low(values, bits), high, ones)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        got = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        if over.any():
            got[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return got & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        place = (word << 6) + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return (place - i).astype(U) << U(self.bits) | self._low(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part under h: the place of the h-th zero, less the zeros."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        r = h - 1
        inside = (h > 0) & (r < zeros[-1])
        out = np.where(h > 0, self.n, 0)
        k = r[inside]
        word = np.searchsorted(zeros, k, "right") - 1
        place = (word << 6) + _select_in_word(~self.high[word], k - zeros[word])
        out[inside] = place - k
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """Index of the first value in [lo, hi) that is at least x; hi if there is none."""
        hi = np.broadcast_to(np.asarray(self.n if hi is None else hi), x.shape).astype(np.int64)
        h = (x >> U(self.bits)).astype(np.int64)
        a = np.minimum(np.maximum(self._below(h), lo), hi)
        b = np.minimum(np.maximum(self._below(h + 1), a), hi)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self.get(mid) < x[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a


class Trie:
    """Contexts, monotone pointers to their successors, and per successor a count and a quantised value.

    Successors are stored relative to their context: each is added to the last
    stored value before its context's range, so the level never falls and a
    search for a word needs its context's base alone.
    """

    FIELDS = ("contexts", "pointers", "successors", "totals")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray) -> None:
        self.levels, self.codes = levels, codes

    @classmethod
    def build(cls, ctx: np.ndarray, succ: np.ndarray, count: np.ndarray, codes: np.ndarray) -> Trie:
        """From distinct (ctx, succ) in order; count > 0."""
        n = len(ctx)
        first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if n else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [n])) - 1 if n else first
        width = succ[last].astype(U) + _ONE if n else np.zeros(0, U)
        base = np.concatenate((np.zeros(1, U), np.cumsum(width)))[:-1] if n else width
        size = np.diff(np.concatenate((first, [n])))
        return cls(
            {
                "contexts": EliasFano.build(ctx[first]),
                "pointers": EliasFano.build(np.concatenate((first, [n]))),
                "successors": EliasFano.build(succ.astype(U) + np.repeat(base, size)),
                "totals": EliasFano.build(np.concatenate(([0], np.cumsum(count.astype(np.int64))))),
            },
            codes.astype(np.uint16),
        )

    def find(self, ctx: np.ndarray, succ: np.ndarray) -> np.ndarray:
        """Index of each (ctx, succ), -1 if absent; queries in order of ctx."""
        out = np.full(len(ctx), -1, np.int64)
        if not len(ctx) or not self.levels["contexts"].n:
            return out
        new = np.concatenate(([True], ctx[1:] != ctx[:-1]))
        one = ctx[new]
        at = self.levels["contexts"].successor(one)
        known = at < self.levels["contexts"].n
        known[known] = self.levels["contexts"].get(at[known]) == one[known]
        at = at[known]
        p = self.levels["pointers"]
        lo, hi = p.get(at).astype(np.int64), p.get(at + 1).astype(np.int64)
        s = self.levels["successors"]
        base = np.zeros(len(lo), U)
        base[lo > 0] = s.get(lo[lo > 0] - 1) + _ONE
        which = np.cumsum(known) - 1
        group = np.cumsum(new) - 1
        q = np.flatnonzero(known[group])
        g = which[group[q]]
        want = base[g] + succ[q].astype(U)
        found = s.successor(want, lo[g], hi[g])
        hit = found < hi[g]
        hit[hit] = s.get(found[hit]) == want[hit]
        out[q[hit]] = found[hit]
        return out

    def counts(self, at: np.ndarray) -> np.ndarray:
        t = self.levels["totals"]
        return (t.get(at + 1) - t.get(at)).astype(np.int64)

    def mapped(self) -> Trie:
        """The same trie on arrays mapped from a file that is unlinked at once."""
        arrays = [a for f in self.FIELDS for a in self.levels[f].parts()] + [self.codes]
        fd, name = tempfile.mkstemp()
        os.unlink(name)
        with os.fdopen(fd, "wb+") as f:
            at = []
            for a in arrays:
                f.write(bytes(-f.tell() % 8))
                at.append(f.tell())
                f.write(a.tobytes())
            f.write(b"\0" * 8)
            f.flush()
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        back = [np.frombuffer(m, a.dtype, len(a), o) for a, o in zip(arrays, at, strict=True)]
        levels = {}
        for k, f in enumerate(self.FIELDS):
            e = self.levels[f]
            levels[f] = EliasFano(e.n, e.bits, *back[3 * k : 3 * k + 3])
        return Trie(levels, back[-1])

    def n_bytes(self) -> int:
        return sum(a.nbytes for f in self.FIELDS for a in self.levels[f].parts()) + self.codes.nbytes
