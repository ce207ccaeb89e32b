"""Elias-Fano sequences and a three-level n-gram trie in one flat, mappable buffer."""

from __future__ import annotations

import mmap
import tempfile
from functools import lru_cache

import numpy as np

U64 = np.uint64


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(zeros of each byte, position of the k-th zero in each byte)."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    place = np.full((256, 9), 8, np.uint8)
    for b in range(256):
        z = np.flatnonzero(bits[b] == 0)
        place[b, : len(z)] = z
    return (8 - bits.sum(1)).astype(np.int64), place


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary, zeros counted per 64 bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.zeros = n, low_bits, low, high, zeros
        self.bytes = high.view(np.uint8)
        self._places: np.ndarray | None = None  # of all zeros, once many are asked for at a time

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(U64)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, U64)
        if width and n:
            at = np.arange(n, dtype=np.int64) * width
            part = v & U64((1 << width) - 1)
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        ones = (v >> U64(width)).astype(np.int64) + np.arange(n)
        size = ((int(ones[-1]) if n else 0) + 2) // 64 + 1  # at least one zero after the last
        flags = np.zeros(size * 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        zeros = np.concatenate([[0], np.cumsum(64 - flags.reshape(-1, 64).sum(1, dtype=np.int64))])
        return cls(n, width, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> shift
        # a shift by 64 is undefined; in two steps it is not
        out |= (self.low[word + 1] << (U64(63) - shift)) << U64(1)
        return out & U64((1 << self.l) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the high part; past the last, its end."""
        if self._places is None and len(k) * 8 > len(self.high):
            self._places = np.flatnonzero(np.unpackbits(self.bytes, bitorder="little") == 0)
        if self._places is not None:
            return np.where(k < len(self._places), self._places[np.minimum(k, len(self._places) - 1)], len(self.high) * 64)
        count, place = _byte_tables()
        word = np.searchsorted(self.zeros, k, "right") - 1
        beyond = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        rest = k - self.zeros[word]
        at = word * 8
        for _ in range(7):
            z = count[self.bytes[at]]
            go = rest >= z
            rest -= np.where(go, z, 0)
            # once a byte holds the zero, its place is kept
            if not go.any():
                break
            at += go
        out = at * 8 + place[self.bytes[at], np.clip(rest, 0, 8)]
        return np.where(beyond, len(self.high) * 64, out)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element >= x, whether it is x), for each x; searched in [lo, hi) where given."""
        x = x.astype(U64)
        h = x >> U64(self.l)
        total = int(self.zeros[-1])
        past = h >= U64(total)
        h = np.minimum(h, U64(total - 1)).astype(np.int64)
        a = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        b = self._select0(h) - h
        a, b = np.where(past, self.n, a), np.where(past, self.n, b)
        if lo is not None:
            a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        want = x & U64((1 << self.l) - 1)
        end = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        exact = a < end
        at = np.flatnonzero(exact)
        exact[at] = self._low(a[at]) == want[at]
        return a, exact

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at i: of few, each through a search for the word that holds its unary bit; of many, from all decoded."""
        if len(i) * 8 > self.n:
            return self.all()[i]
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        bits = np.unpackbits(self.bytes.reshape(-1, 8)[word], axis=1, bitorder="little")
        nth = i - ones[word]
        seen = np.cumsum(bits, axis=1, dtype=np.int64)
        at = np.argmax(seen > nth[:, None], axis=1)
        h = word * 64 + at - i
        return h.astype(U64) << U64(self.l) | self._low(i)

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.bytes, bitorder="little"))
        return (ones - i).astype(U64) << U64(self.l) | self._low(i)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l], np.int64), self.low, self.high, self.zeros]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ in any column from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


#: Bits by which a word is told among the neighbours of one word.
NEAR = 40


class Trie:
    """Words, their successors, and the successors of pairs, with quantised probabilities.

    Level one: words v (64-bit hashes) with a two-byte code each. Level two: the
    successors w of each v (``NEAR`` bits of their hashes), a byte each. Level
    three: for each v the words u before it, a byte each for the share that goes
    to level two, and for each (u, v) its successors, a byte each. There a
    successor is given relative to its context: by its place among those of v in
    level two. A level is one monotone Elias-Fano sequence: a context's part is
    shifted by the context's rank, and monotone pointers say where it begins.
    """

    SEQUENCES = ("words", "to_next", "next", "to_before", "before", "to_after", "after")
    ARRAYS = ("codes1", "codes2", "shares", "codes3")

    def __init__(self, sequences: list[EliasFano], arrays: list[np.ndarray], span: int):
        for name, value in zip(self.SEQUENCES + self.ARRAYS, [*sequences, *arrays], strict=True):
            setattr(self, name, value)
        self.span = span

    @classmethod
    def build(cls, words: np.ndarray, codes1: np.ndarray, two: tuple, three: tuple) -> Trie:
        """``words``: sorted; ``two``: (v, w, code) sorted by (v, w), v as a place in ``words``; ``three``: (v, u, w, code, share) sorted by (v, u, w).

        Every (v, w) of ``three`` must be in ``two``.
        """
        v2, w2, c2 = two
        v3, u3, w3, c3, share = three
        m = len(words)
        at2 = np.searchsorted(v2, np.arange(m + 1))
        key2 = v2.astype(U64) << U64(NEAR) | w2
        fresh = np.flatnonzero(_starts(v3, u3)) if len(v3) else np.zeros(0, np.int64)
        place = np.searchsorted(key2, v3.astype(U64) << U64(NEAR) | w3) - at2[v3] if len(v3) else v3
        span = int(place.max()) + 1 if len(place) else 1
        pair = np.repeat(np.arange(len(fresh)), np.diff(np.concatenate([fresh, [len(v3)]])))
        sequences = [
            words, at2, key2, np.searchsorted(v3[fresh], np.arange(m + 1)), v3[fresh].astype(U64) << U64(NEAR) | u3[fresh],
            np.concatenate([fresh, [len(v3)]]), pair.astype(U64) * U64(span) + place.astype(U64),
        ]
        return cls([EliasFano.build(x) for x in sequences], [codes1.astype(np.uint16), c2.astype(np.uint8), share[fresh].astype(np.uint8), c3.astype(np.uint8)], span)

    @staticmethod
    def _range(to: EliasFano, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        lo[known] = to.get(at[known]).astype(np.int64)
        hi[known] = to.get(at[known] + 1).astype(np.int64)
        return lo, hi

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each word."""
        return self.words.successor(v)

    def number_next(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many successors each found word has."""
        lo, hi = self._range(self.to_next, at, known)
        return hi - lo

    def pairs(self, at: np.ndarray, known: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, place among the successors of v or -1) of each (v, w): a successor search within the part of v."""
        lo, hi = self._range(self.to_next, at, known)
        i, found = self.next.successor(at.astype(U64) << U64(NEAR) | w, lo, hi)
        code, place = np.zeros(len(w), np.uint8), np.full(len(w), -1)
        code[found], place[found] = self.codes2[i[found]], i[found] - lo[found]
        return code, place

    def triples(self, at: np.ndarray, known: np.ndarray, u: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, share code) of each (u, v, w) by the ``place`` of w: successor searches within the parts of v and of (u, v); share 255 where (u, v) is unknown."""
        lo, hi = self._range(self.to_before, at, known)
        i, found = self.before.successor(at.astype(U64) << U64(NEAR) | u, lo, hi)
        share = np.full(len(u), 255, np.uint8)
        share[found] = self.shares[i[found]]
        code = np.zeros(len(u), np.uint8)
        m = np.flatnonzero(found & (place >= 0) & (place < self.span))
        lo, hi = self._range(self.to_after, i[m], np.ones(len(m), bool))
        j, hit = self.after.successor(i[m].astype(U64) * U64(self.span) + place[m].astype(U64), lo, hi)
        code[m[hit]] = self.codes3[j[hit]]
        return code, share

    def to_bytes(self) -> bytes:
        arrays = [p for name in self.SEQUENCES for p in getattr(self, name).parts()] + [getattr(self, name) for name in self.ARRAYS] + [np.array([self.span], np.int64)]
        pad = [a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays]
        head = np.array([len(arrays), *[x for a in arrays for x in (a.nbytes, {"i": 0, "u": 1}[a.dtype.kind] * 16 + a.itemsize)]], np.int64)
        return head.tobytes() + b"".join(pad)

    @classmethod
    def mapped(cls, blob: bytes) -> Trie:
        """The levels of ``blob`` memory-mapped from a file that vanishes with the mapping."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            m = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        count = int(np.frombuffer(m, np.int64, 1)[0])
        sizes = np.frombuffer(m, np.int64, 2 * count, 8).reshape(-1, 2)
        kinds = {8: np.int64, 24: np.uint64, 17: np.uint8, 18: np.uint16}
        at, arrays = 8 * (1 + 2 * count), []
        for size, kind in sizes.tolist():
            dtype = np.dtype(kinds[kind])
            arrays.append(np.frombuffer(m, dtype, size // dtype.itemsize, at))
            at += size + -size % 8
        n = len(cls.SEQUENCES)
        sequences = [EliasFano(int(arrays[4 * k][0]), int(arrays[4 * k][1]), *arrays[4 * k + 1 : 4 * k + 4]) for k in range(n)]
        return cls(sequences, arrays[4 * n : -1], int(arrays[-1][0]))
