"""Vectorised text kernels shared by the operators of this subpackage.

All kernels work on a *block*: the UTF-8 bytes of a few documents laid end to end,
with the offsets of the documents in it.  Words are maximal runs of bytes outside
0x20 and 0x09-0x0D, found on bytes, so a code point is never split.  Hashes are
64-bit, keyed by fixed seeds, and depend only on the bytes that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one block holds at most, unless one document is longer.
BLOCK_BYTES = 1 << 19

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any byte range of a block in constant time."""

    def __init__(self, buf: np.ndarray):
        fwd, self.inv = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[buf] * fwd[: len(buf)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of bytes [start, end), its length included."""
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, after, bytes, offsets) with at most ``limit`` bytes, or one row."""
    buf, offs = strings(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of a block: start and end bytes, document, and offsets by document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        n = len(buf)
        inside = ~SEPARATOR[buf]
        first = inside.copy()
        last = inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cuts = offs[(offs > 0) & (offs < n)]
            first[cuts] |= inside[cuts]
            last[cuts - 1] |= inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offs = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.offs))

    def hashes(self) -> np.ndarray:
        return Rolling(self.buf).of(self.start, self.end)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items, in order; windows that cross documents are for the caller to drop."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = out * U(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k]
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and offsets by document.

    A document with fewer than n words, but at least one, has its whole sequence as its only shingle.
    """
    h, count = w.hashes(), np.diff(w.offs)
    long = np.maximum(count - n + 1, 0)
    out = np.where(count > 0, np.maximum(long, 1), 0)
    offs = np.concatenate([[0], np.cumsum(out)])
    got = np.empty(offs[-1], dtype=np.uint64)
    if len(h) >= n:
        g = grams(h, n)
        got[_ranges(offs[:-1], long)] = g[_ranges(w.offs[:-1], long)]
    for d in np.flatnonzero((count > 0) & (count < n)):
        got[offs[d]] = grams(h[w.offs[d] : w.offs[d + 1]], int(count[d]))[0] ^ U(count[d])
    return got, offs


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + length[i] - 1 of all i, in order."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return shift + np.arange(total)


def distinct_by_doc(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document, ascending, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each start s, the leftmost position of the smallest of h[s : s + width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, span = np.arange(len(h)), 1
    while span * 2 <= width:
        left, right = at[: len(at) - span], at[span:]
        at = np.where(h[right] < h[left], right, left)
        span *= 2
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(h[right] < h[left], right, left)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def binary_rows(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of type binary that lie end to end in ``data``."""
    raw = pa.py_buffer(np.ascontiguousarray(data)) if isinstance(data, np.ndarray) else pa.py_buffer(data)
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs), raw])
