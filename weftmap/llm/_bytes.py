"""Kernels on the UTF-8 bytes of many texts at once.

An Arrow string column is one buffer of bytes with offsets. The functions here
work on slices of it that hold whole texts, about ``CHUNK`` bytes each (one
longer text is a slice of its own), so memory is bounded by that and by the
longest text.

Two kinds of hashes: :class:`Sums` are polynomials over bytes modulo 2^64, so
that every window of a length has its hash by a difference and a product. They
only choose places: texts are known whose polynomials agree. What stands for a
content is a hash of :class:`Blocks`, 8 bytes at a time, each of which is mixed
on its own; two lanes of it are 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(2)
def byte_table(lower: bool) -> np.ndarray:
    """A random odd-looking 64-bit number for each byte; A-Z share those of a-z if ``lower``."""
    t = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    if lower:
        t[65:91] = t[97:123]
    return t


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        for which, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.ones(size, U)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
                done *= 2
            _POWERS[which] = out
    return _POWERS[0], _POWERS[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCKS = 1 << 19  # blocks that are mixed at a time


class Blocks:
    """Hashes of substrings of one buffer, by blocks of 8 bytes; no arithmetic relation between blocks survives the mixing."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        self._padded = np.zeros(len(data) + 8, np.uint8)
        self._padded[: len(data)] = _LOWER[data] if lower else data
        self._wide = np.ndarray((len(data) + 1,), "<u8", self._padded, strides=(1,))

    def of(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each substring; other lanes are independent hashes."""
        size = ends - starts
        blocks = np.maximum(1, (size + 7) >> 3)
        if (blocks == 1).all():
            return self._some(starts, size, np.arange(len(size)), np.zeros(len(size), np.int64), lane)
        out = np.empty(len(size), U)
        upto = np.cumsum(blocks)
        low = 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _BLOCKS, "right")))
            n = blocks[low:high]
            owner = np.repeat(np.arange(high - low), n)
            out[low:high] = self._some(starts[low:high], size[low:high], owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), lane)
            low = high
        return out

    def _some(self, starts, size, owner, k, lane) -> np.ndarray:
        """``k``: the number of each block within its substring, ``owner``: which that is."""
        alone = len(owner) == len(size)
        at, left = (starts, size) if alone else (starts[owner] + 8 * k, size[owner] - 8 * k)
        block = self._wide[at]
        last = np.flatnonzero(left < 8)
        block[last] &= (U(1) << (U(8) * left[last].astype(U))) - U(1)
        seed = U((0xA0761D6478BD642F * (2 * lane + 1)) & _MASK)
        mixed = mix(block ^ seed)
        if not alone:
            mixed *= mix(k.astype(U) * U(0xD6E8FEB86659FD93) + seed) | U(1)
            mixed = np.add.reduceat(mixed, np.flatnonzero(k == 0)) if len(k) else np.zeros(0, U)
        else:
            mixed *= mix(np.array([seed], U)) | U(1)
        return mix(mixed + size.astype(U) * U(0x8EBC6AF09C88C6E3) + seed)


class Sums:
    """Polynomials of substrings of one buffer."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        power, self._inverse = powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, U)
        np.cumsum(byte_table(lower)[data] * power[: len(data)], out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sum[ends] - self._sum[starts]) * self._inverse[starts]

    def grams(self, k: int) -> np.ndarray:
        """Of every substring of k bytes, by its start."""
        n = len(self._sum) - k
        return (self._sum[k:] - self._sum[:n]) * self._inverse[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, size: int = CHUNK):
    """(first row, bytes, offsets) of consecutive slices that hold whole texts."""
    data, at = column_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the same texts with every run of white space as one space."""
    white = WHITE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text's first byte stays, whatever is before it
    out = data[keep]
    out[white[keep]] = 32
    return out, np.concatenate(([0], np.cumsum(keep)))[offsets]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the first of its words (n + 1 numbers)."""
    ink = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink
    ends = ends.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)
