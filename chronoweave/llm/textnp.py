"""Vectorised work on batches of UTF-8 texts: words, their hashes, n-gram hashes.

Texts stay in the contiguous buffers that Arrow hands over; a hash of any span
comes from two prefix sums, so a batch of any length takes a fixed number of
numpy passes and no loop over texts or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The bytes that separate words.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a separator, random 64 bits of the byte, the same with A-Z lower-cased)."""
    sep = np.zeros(256, bool)
    sep[list(SEPARATORS)] = True
    rnd = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=U64)
    low = rnd.copy()
    low[65:91] = rnd[97:123]
    return sep, rnd, low


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's multiplier and of its inverse modulo 2^64."""
    p = np.full(n, _P, U64)
    q = np.full(n, _P_INV, U64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, most: int = 1 << 20, texts: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts, ``most`` bytes (or one text) and ``texts`` texts at most: (first, past the last, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), i + texts)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """C with C[e] - C[s] = sum over s <= i < e of table[byte i] * P^i, modulo 2^64."""
    c = np.zeros(len(data) + 1, U64)
    p, _ = _powers(len(data) + 1)
    np.cumsum(table[data] * p[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that depend on their bytes alone."""
    _, q = _powers(len(c))
    return mix((c[end] - c[start]) * q[start])


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the words; none crosses a text's edge.

    ``sep``: which bytes separate words, :data:`SEPARATORS` unless given.
    """
    inside = ~(tables()[0] if sep is None else sep)[data]
    edge = off[:-1][off[:-1] < len(data)]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    end[last] = inside[last]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words, A-Z lower-cased; words before each text)."""
    s, e, first = word_spans(data, off)
    return span_hash(prefix_sums(data, tables()[2]), s, e), first


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the number of items before each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` items within each text; windows before each text.

    A text of fewer items, but some, has one window: all of them.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    before = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(before[-1]) - np.repeat(before[:-1], count) + np.repeat(first[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    out = np.zeros(before[-1], U64)
    k = U64(0xA0761D6478BD642F | 1)
    for j in range(width):
        use = size > j
        at = np.minimum(pos + j, max(0, len(h) - 1))
        out = np.where(use, (out * k) + h[at] if len(h) else out, out)
    return mix(out + size.astype(U64)), before
