"""Keyed coins for whole batches: the numbers of ``bits.coin`` without a digest call for each of them.

A coin is the first 32 bits of md5("seed|record|bit|draw").  The digests of a batch are computed side by side
in arrays; what the messages of a record share is laid out once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = np.uint32
#: Digests that are computed side by side; their arrays stay in the second-level cache.
LANES = 1 << 14
#: Records whose bits lie side by side as booleans.
ROWS = 1024
_STEP = [U32(int(abs(math.sin(i + 1)) * 4294967296)) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = tuple(U32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _word(i: int) -> int:
    return (i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16]


def _compress(state: tuple, words: list, shape: tuple[int, ...], last: bool) -> tuple:
    """One block of md5 over arrays of words that broadcast to ``shape``; of the last block only the first word is computed."""
    a, b, c, d = (np.broadcast_to(np.asarray(v, dtype=U32), shape).copy() for v in state)
    f, t = np.empty(shape, dtype=U32), np.empty(shape, dtype=U32)
    for i in range(61 if last else 64):
        if i < 16:  # (b & c) | (~b & d)
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # (d & b) | (~d & c)
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[_word(i)] + _STEP[i], out=f)
        turn = _TURN[i // 16][i % 4]
        np.left_shift(f, U32(turn), out=t)
        np.right_shift(f, U32(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    if last:
        # three steps early, the first word's register is still b
        return (b + np.asarray(state[0], dtype=U32),)
    return tuple(x + np.asarray(s, dtype=U32) for x, s in zip((a, b, c, d), state, strict=True))


def _digests(head: list, tail: list, shape: tuple[int, ...]) -> np.ndarray:
    """The first 32 bits, as a number, of messages whose words are sums of a record's and a position's."""
    state: tuple = _START
    with np.errstate(over="ignore"):
        for at in range(0, len(head), 16):
            words = [h if t is None else t if h is None else h + t for h, t in zip(head[at : at + 16], tail[at : at + 16], strict=True)]
            state = _compress(state, [U32(0) if w is None else w for w in words], shape, at + 16 == len(head))
        return state[0].byteswap()


class Coins:
    """Coins of records, named by their text, as integers below 2**32: u < p is ``coin < below(p)``."""

    def __init__(self, seed: str, rows: list[str | None]):
        texts = [(f"{seed}|{r}|" if r is not None else f"{seed}|").encode() for r in rows]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.count, self.groups, self.group_of, self.place = len(texts), [], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for k, size in enumerate(np.unique(sizes)):
            mine = np.flatnonzero(sizes == size)
            self.group_of[mine], self.place[mine] = k, np.arange(len(mine))
            self.groups.append((int(size), mine, np.frombuffer(b"".join(texts[i] for i in mine), dtype=np.uint8).reshape(len(mine), size)))

    def _laid(self, size: int, heads: np.ndarray, positions: np.ndarray, draw: str):
        """For each number of blocks: the places of the positions, the words of the records and of the positions."""
        ends = [f"{p}|{draw}".encode() for p in positions.tolist()]
        long = np.array([len(e) for e in ends], dtype=np.int64) + size
        blocks = (long + 72) // 64
        for n in np.unique(blocks):
            mine = np.flatnonzero(blocks == n)
            tail = np.zeros((len(mine), 64 * n), dtype=np.uint8)
            for row, k in enumerate(mine.tolist()):
                e = ends[k] + b"\x80"
                tail[row, size : size + len(e)] = np.frombuffer(e, dtype=np.uint8)
            tail.view("<u8")[:, -1] = long[mine] * 8
            head = np.zeros((len(heads), 64 * n), dtype=np.uint8)
            head[:, :size] = heads
            yield mine, head.view("<u4"), tail.view("<u4")

    @staticmethod
    def _columns(table: np.ndarray, shaped: Callable[[np.ndarray], np.ndarray]) -> list:
        return [shaped(np.ascontiguousarray(table[:, g])) if table[:, g].any() else None for g in range(table.shape[1])]

    def grid(self, positions: np.ndarray, draw: str) -> np.ndarray:
        """Coins of every record (rows) at every position (columns)."""
        out = np.empty((self.count, len(positions)), dtype=U32)
        for size, mine, heads in self.groups:
            for places, head, tail in self._laid(size, heads, positions, draw):
                columns = self._columns(tail, lambda v: v[None, :])
                step = max(1, LANES // len(places))
                for at in range(0, len(mine), step):
                    part = head[at : at + step]
                    got = _digests(self._columns(part, lambda v: v[:, None]), columns, (len(part), len(places)))
                    if len(places) == len(positions):
                        out[mine[at : at + step]] = got
                    else:
                        out[np.ix_(mine[at : at + step], places)] = got
        return out

    def at(self, rows: np.ndarray, positions: np.ndarray, draw: str) -> np.ndarray:
        """Coins of given pairs of a record's number and a position."""
        out = np.empty(len(rows), dtype=U32)
        known, which = np.unique(positions, return_inverse=True)
        for k, (size, _, heads) in enumerate(self.groups):
            here = np.flatnonzero(self.group_of[rows] == k)
            for places, head, tail in self._laid(size, heads, known, draw):
                row_of = np.full(len(known), -1, dtype=np.int64)
                row_of[places] = np.arange(len(places))
                lanes = here if len(places) == len(known) else here[row_of[which[here]] >= 0]
                for at in range(0, len(lanes), LANES):
                    some = lanes[at : at + LANES]
                    h, t = head[self.place[rows[some]]], tail[row_of[which[some]]]
                    out[some] = _digests(self._columns(h, lambda v: v), self._columns(t, lambda v: v), (len(some),))
        return out


def below(p: float | np.ndarray) -> np.ndarray:
    """The least integer that is not below p * 2**32, so that coin < p is an integer comparison."""
    return np.ceil(np.clip(np.asarray(p, dtype=np.float64), 0.0, 1.0) * 4294967296.0).astype(np.uint64)


def above(p: float) -> np.uint64:
    """coin > p is integer > above(p)."""
    return np.uint64(math.floor(min(max(p, 0.0), 1.0) * 4294967296.0))


def matrix(bits: pa.Array, n: int) -> np.ndarray:
    """Arrays of positions as rows of booleans; positions outside 0..n-1 are none, a null array is empty."""
    out = np.zeros((len(bits), n), dtype=bool)
    rows, values = pc.list_parent_indices(bits), pc.list_flatten(bits)
    if values.null_count:
        rows, values = rows.filter(values.is_valid()), values.drop_null()
    rows, values = rows.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
    keep = (values >= 0) & (values < n)
    out[rows[keep], values[keep]] = True
    return out


def lists(found: np.ndarray) -> pa.ListArray:
    """Rows of booleans as arrays of ascending positions."""
    ends = np.concatenate([[0], np.cumsum(np.count_nonzero(found, axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(found)[1].astype(np.int32)))


def words(found: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the lowest bit first."""
    n = -(-found.shape[1] // 64) * 64
    packed = np.packbits(np.pad(found, ((0, 0), (0, n - found.shape[1]))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<i8")


def _vectors(kernel: Callable, seed: str | None, shown: Callable, kind: str) -> Callable:
    """A function of whole columns, for batches of bounded size: ``kernel(columns, coins)`` gives rows of booleans."""

    def run(columns):
        rows = columns[-1].to_pylist() if seed is not None else None
        out = []
        for at in range(0, len(columns[0]), ROWS):
            part = [c.slice(at, ROWS) for c in columns]
            out.append(shown(kernel(part, None if rows is None else Coins(seed, rows[at : at + ROWS]))))
        return pa.concat_arrays(out) if out else shown(np.zeros((0, 0), dtype=bool))

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return run([a])

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run([a, b])

    @F.arrow_udf(kind)
    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run([a, b, c])

    @F.arrow_udf(kind)
    def four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return run([a, b, c, d])

    return lambda *c: (one, two, three, four)[len(c) - 1](*c)


def _held(bits: Column) -> tuple[Column, Column]:
    """A vector and its size.  Spark moves an expression into the one place that uses it, and leaves a Python function
    unplanned if lambdas come with its argument; what is used twice stays a column of its own."""
    return bits, F.size(bits)


def positions(kernel: Callable, seed: str | None, *columns: Column) -> Column:
    """Sorted positions that the kernel finds; with a seed the last column names the record of the coins."""
    return _vectors(kernel, seed, lists, "array<int>")(*columns)


def noisy(bits: Column, n: int, row: Column, kernel: Callable, seed: str, *more: Column) -> Column:
    """The positions below n that ``kernel(was, coins, *more)`` keeps, of booleans that say which are set."""
    return positions(lambda part, coins: kernel(matrix(part[0], n), coins, *part[2:-1]), seed, *_held(bits), *more, row.cast("string"))


def mapped(bits: Column, n: int, kernel: Callable) -> Column:
    """The vector that ``kernel`` makes of rows of booleans; null stays null."""
    return F.when(bits.isNotNull(), positions(lambda part, _: kernel(matrix(part[0], n)), None, *_held(bits)))


def _blobs(found: np.ndarray) -> pa.Array:
    w = words(found)
    return pa.array([r.tobytes() for r in w], pa.binary())


def packed(bits: Column, n: int) -> Column:
    """The words of a vector as bytes, 8 for each, the lowest bit first."""
    return _vectors(lambda part, _: matrix(part[0], n), None, _blobs, "binary")(*_held(bits))


def word_columns(bits: Column, n: int) -> Column:
    """The words of a vector as an array of longs; as ``bits.word_array``, for whole batches."""
    shown = lambda found: pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * -(-n // 64)), pa.array(words(found).ravel()))
    return _vectors(lambda part, _: matrix(part[0], n), None, shown, "array<bigint>")(*_held(bits))


def response(p: float) -> Callable:
    """Ones stay, zeros become one where the coin falls below p."""
    return lambda was, coins: was | (coins.grid(np.arange(was.shape[1]), "response") < below(p))


def replaced(was: np.ndarray, coins: Coins, probs: float | np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Each bit is replaced by a fair coin with its probability, among the positions ``where`` if given."""
    out = was.copy()
    rows, at = np.nonzero(coins.grid(np.arange(was.shape[1]), "replace") < below(probs))
    if where is not None:
        rows, at = rows[where[rows, at]], at[where[rows, at]]
    out[rows, at] = coins.at(rows, at, "fair") < below(0.5)
    return out
