"""Numbers of a bounded domain as noisy bit vectors, and distances estimated from two of them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions import coins as C
from lumenlink.functions.jrandom import JavaRandom

SEED, SEGMENT, COIN, EPSILON = "numbers", 10, 0.8, 1.0
#: Hamming distances are divided by this before they are scaled; 1.0 is the unbiased form.
DIVISOR = 1.1


def thresholds(m: int, low: float, high: float, seed: int = 42) -> list[float]:
    """The shared random vector."""
    r = JavaRandom(seed)
    return [(high - low) * r.next_double() + low for _ in range(m)]


def threshold_bits(value: Column, shared: list[float]) -> Column:
    """Bit i says whether the value reaches the i-th threshold; none of a null."""

    def reached(part, _):
        v = part[0].cast("double").to_numpy(zero_copy_only=False)
        return ((v[:, None] >= np.array(shared)) | np.isnan(v)[:, None]) & part[0].is_valid().to_numpy(zero_copy_only=False)[:, None]

    return C.positions(reached, None, value.cast("double"))


def flipped(bits: Column, m: int, row: Column, flip: Callable, seed: str) -> Column:
    """The vector with the bits changed that ``flip(records, coins)`` marks; none of a null."""
    kept = C.noisy(bits, m, row, lambda was, coins: was != flip(len(was), coins), seed)
    return F.when(bits.isNotNull(), kept).otherwise(F.array().cast("array<int>"))


def noise_dprl(bits: Column, m: int, row: Column, f: float = COIN, seed: str = SEED) -> Column:
    """Each bit flips if one coin exceeds f and another one half."""

    def flip(count, coins):
        out = coins.grid(np.arange(m), "first") > C.above(f)
        rows, at = np.nonzero(out)
        out[rows, at] = coins.at(rows, at, "second") > C.above(0.5)
        return out

    return flipped(bits, m, row, flip, seed)


def flip_probability(epsilon: float = EPSILON) -> float:
    return 1 / (math.exp(epsilon) + 1)


def _answers(count: int, coins, m: int, at: np.ndarray, epsilon: float) -> np.ndarray:
    """Flips of one position of each segment, ``at``, of each record or of all."""
    rows, picks = np.repeat(np.arange(count), at.shape[-1]), np.broadcast_to(at, (count, at.shape[-1])).ravel()
    out = np.zeros((count, m), dtype=bool)
    out[rows, picks] = coins.at(rows, picks, "response") < C.below(flip_probability(epsilon))
    return out


def noise_v1(bits: Column, m: int, row: Column, epsilon: float = EPSILON, seed: str = SEED) -> Column:
    """In each segment of ten bits one bit, chosen for the record, flips with probability 1 / (e**epsilon + 1)."""

    def flip(count, coins):
        starts = np.arange(0, m, SEGMENT)
        chosen = np.floor(coins.grid(starts, "pick") / 4294967296.0 * np.minimum(SEGMENT, m - starts)).astype(np.int64)
        return _answers(count, coins, m, starts + chosen, epsilon)

    return flipped(bits, m, row, flip, seed)


def shared_picks(m: int, seed: int = 42) -> list[int]:
    r = JavaRandom(seed)
    return [a + r.next_int(min(SEGMENT, m - a)) for a in range(0, m, SEGMENT)]


def noise_v2(bits: Column, m: int, row: Column, epsilon: float = EPSILON, seed: str = SEED, picks: list[int] | None = None) -> Column:
    """As v1 with the same bit of each segment for all records."""
    # only the position that a segment's own entry names is in that segment
    shared = np.array([p for k, p in enumerate(picks or shared_picks(m)) if p // SEGMENT == k and p < m], dtype=np.int64)
    return flipped(bits, m, row, lambda count, coins: _answers(count, coins, m, shared, epsilon), seed)


def noise_v3(bits: Column, m: int, row: Column, epsilon: float = EPSILON, seed: str = SEED) -> Column:
    """Zeros become one with probability exp(-epsilon)."""
    return C.noisy(bits, m, row, C.response(math.exp(-epsilon)), seed)


def ue_bits(value: Column, low: float, high: float, row: Column, gap: float = 1.0, epsilon: float = EPSILON, seed: str = SEED) -> Column:
    """One-hot of the first grid point above the value, none at or above the domain's end; then zeros as in v3."""
    size = int((high - low) / gap + 1)

    def answered(part, coins):
        v = part[0].to_numpy(zero_copy_only=False)
        hot = np.maximum(0, np.floor((v - low) / gap) + 1)
        hot = np.where(part[0].is_valid().to_numpy(zero_copy_only=False), hot, 0)
        return (np.arange(size) == hot[:, None]) | (coins.grid(np.arange(size), "response") < C.below(math.exp(-epsilon)))

    return C.positions(answered, seed, value.cast("double"), row.cast("string"))


def est_plain(h: Column, m: int, width: float, divisor: float = DIVISOR) -> Column:
    return h / divisor * width / m


def est_dprl(h: Column, m: int, width: float, f: float = COIN, divisor: float = DIVISOR) -> Column:
    return (h / divisor / m - (1 - f * f) / 2) * width / (f * f)


def segment_terms(m: int, method: str, epsilon: float = EPSILON) -> tuple[float, float]:
    """(noise, slope) of a Hamming distance whose mean is noise + slope * true bits / m.

    A pair of bits changes with chance c = 2 f (1 - f) if each of them flips with chance f; it then adds c
    where the bits are equal and 1 - c where they are not.  In v1 all bits of a segment of s flip with f / s, in v2
    one of them with f.
    """
    f = flip_probability(epsilon)
    changed = lambda share: 2 * share * (1 - share)
    of_segment = (lambda s: s * changed(f / s)) if method == "v1" else (lambda s: changed(f))
    full, rest = divmod(m, SEGMENT)
    noise = full * of_segment(SEGMENT) + (of_segment(rest) if rest else 0.0)
    return noise, m - 2 * noise


def est_segments(h: Column, m: int, width: float, method: str, epsilon: float = EPSILON, divisor: float = DIVISOR) -> Column:
    noise, slope = segment_terms(m, method, epsilon)
    return (h / divisor - noise) * width / slope


def est_value(ones: Column, m: int, low: float, high: float, epsilon: float = EPSILON) -> Column:
    """The number behind a v3 vector; computed once for each record."""
    p = math.exp(-epsilon)
    return (ones / m * (high - low) - high * p + low) / (1 - p)


def est_v3(h: Column | np.ndarray, value_a: Column | np.ndarray, value_b: Column | np.ndarray, m: int, low: float, high: float, epsilon: float = EPSILON, divisor: float = DIVISOR) -> Column:
    p = math.exp(-epsilon)
    larger = F.greatest if isinstance(value_a, Column) else np.maximum
    return h / divisor * (high - low) / m / (1 - p) - (high - larger(value_a, value_b)) * (2 * p)


def ue_sum(bits: Column, low: float, gap: float = 1.0) -> Column:
    """Sum of the grid points of the set bits; computed once for each record."""
    return F.aggregate(bits, F.lit(0.0), lambda acc, p: acc + p * gap + low)


def est_ue(sum_a: Column | np.ndarray, sum_b: Column | np.ndarray, epsilon: float = EPSILON) -> Column | np.ndarray:
    size = F.abs if isinstance(sum_a, Column) else np.abs
    return size(sum_a - sum_b) / (1 - math.exp(-epsilon))


def all_pairs(df: DataFrame, row: str, columns: list[str], blocks: int = 32) -> DataFrame:
    """All unordered pairs of records as pairs of their ids and columns, suffixed _a and _b, with the number of pairs of records as ``pairs``.

    Records with equal columns are one, with a weight, so what does not tell records apart is paired once, under its
    least id.  The rest are dealt into ``blocks`` by a hash; every unordered pair of blocks meets once under a key of its
    own, so the pairing is an equi-join of groups that a larger ``blocks`` makes smaller.  The lesser id is side a.
    For vectors that noise tells apart use ``distances``.
    """
    kinds = df.groupBy(*columns).agg(F.min(row).alias("_row"), F.max(row).alias("_last"), F.count(F.lit(1)).alias("_n"))
    kinds = kinds.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    side = lambda s, x, y: kinds.select(F.struct(F.col("_row").alias(row), *columns).alias(f"_{s}"), F.col("_n").alias(f"_n_{s}"), x.alias("_x"), y.alias("_y"))
    left = side("l", F.col("_block"), F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1))))
    right = side("r", F.explode(F.sequence(F.lit(0), F.col("_block"))), F.col("_block"))
    lesser = F.col(f"_l.{row}") < F.col(f"_r.{row}")
    met = left.join(right, ["_x", "_y"]).where((F.col("_x") < F.col("_y")) | lesser)
    met = met.select(F.when(lesser, F.col("_l")).otherwise(F.col("_r")).alias("_a"), F.when(lesser, F.col("_r")).otherwise(F.col("_l")).alias("_b"), (F.col("_n_l") * F.col("_n_r")).alias("pairs"))
    met = met.select(*(F.col(f"_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in (row, *columns)), "pairs")
    ends = {"a": "_row", "b": "_last"}
    alike = kinds.where("_n > 1").select(*(F.col(ends[s] if c == row else c).alias(f"{c}_{s}") for s in "ab" for c in (row, *columns)), F.expr("_n * (_n - 1) div 2").alias("pairs"))
    return met.unionByName(alike)


#: Records of each side whose distances lie side by side, and the least number of one value that has a tile of its own.
TILE, ALONE = 1024, 32


class _Right:
    """Vectors of a tile, to be met by others: one float holds the bits of a position of several records, in fields of equal size."""

    def __init__(self, side: "_Side", part: slice):
        self.words, self.bits, self.x = side.packed[part].view(np.uint64), side.bits(part), None if side.x is None else np.unique(side.x[part], return_inverse=True)
        self.count, self.held = len(self.bits), {}

    def fields(self, k: int) -> np.ndarray:
        """A row for each position and one of ones, a column for k records."""
        if k not in self.held:
            rows = np.zeros((-(-self.count // k) * k, self.bits.shape[1] + 1), dtype=np.int32)
            rows[: self.count, :-1], rows[:, -1] = self.bits, 1
            self.held[k] = np.ascontiguousarray(sum(rows[f::k] << (24 // k * f) for f in range(k)).T.astype(np.float32))
        return self.held[k]


class _Left:
    """Vectors of a tile by their difference from the most common bits of the tile, of which few are ones; by the number x and the number of ones."""

    def __init__(self, side: "_Side", part: slice):
        bits = side.bits(part)
        common = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
        self.words = np.packbits(np.pad(common, (0, side.packed.shape[1] * 8 - len(common))), bitorder="little").view(np.uint64)
        flips = bits != common
        ones = np.count_nonzero(flips, axis=1)
        x = np.zeros(len(bits)) if side.x is None else side.x[part]
        order = np.lexsort((ones, x))
        flips, ones, x = flips[order], ones[order], x[order]
        self.first = np.flatnonzero(np.append(True, (np.diff(ones) != 0) | (np.diff(x) != 0)))
        self.ends, self.ones, self.x, self.count = np.append(self.first[1:], len(bits)), ones[self.first].astype(np.int64), x[self.first], len(bits)
        at = np.flatnonzero(flips.any(axis=0))
        # where the common bit is one, a flip meets the zeros of the other side, which are ones less its ones
        self.signed, self.plain = np.where(common[at], -1, 1).astype(np.int8) * flips[:, at], np.count_nonzero(flips & common, axis=1)
        self.at = np.append(at, len(common))

    def flipped_in(self, right: _Right, some: np.ndarray | None, k: int) -> np.ndarray:
        """For each record of both sides, how many flips of the left one lie where the right one differs from the common bits, too.

        A product of floats below 2**24 is exact, and no partial sum of a row exceeds its flips times the value of ones in all
        fields; so k counts that fit 24 / k bits come from one product.
        """
        fields = right.fields(k)
        fields = fields if len(self.at) == len(fields) else fields[self.at]
        mine = np.empty((self.count, len(self.at)), dtype=np.float32)
        mine[:, :-1], mine[:, -1] = self.signed, self.plain
        met = (mine @ (fields if some is None else fields[:, some])).astype(np.int32)
        if k == 3:
            return met.view(np.uint8)
        return np.stack([met & 4095, met >> 12], axis=2).astype(np.uint16).reshape(len(met), -1) if k == 2 else met


def _reach(estimate: Callable, xa: np.ndarray, xb: np.ndarray, limit: float, m: int) -> np.ndarray:
    """The largest Hamming distance whose rising estimate does not exceed the limit, or -1, for each pair of numbers."""
    h = np.full((len(xa), len(xb)), -1, dtype=np.int64)
    for k in range(m.bit_length(), -1, -1):
        more = h + (1 << k)
        h = np.where((more <= m) & (estimate(np.minimum(more, m).astype(np.float64), xa[:, None], xb[None, :]) <= limit), more, h)
    return h


def _meet_flips(a: _Left, b: _Right, estimate: Callable | None, limits: np.ndarray, m: int, ends: bool) -> tuple:
    """(least, most, pairs within each limit) of two tiles of different records, each once, for an estimate that rises with the Hamming distance.

    That is the flips of one side plus the differences of the other less twice those at the same positions.  What the
    numbers of both alone decide is not computed.
    """
    v = np.bitwise_count(b.words ^ a.words).sum(axis=1, dtype=np.int64)
    low, high = np.maximum(0, np.maximum(v - a.ones.max(), a.ones.min() - v)), np.minimum(m, v + a.ones.max())
    inverse = np.zeros(b.count, dtype=np.int64) if b.x is None else b.x[1]
    reach = [np.full((len(a.x), 1), t, dtype=np.int64) if b.x is None else _reach(estimate, a.x, b.x[0], t, m) for t in limits]
    inside = [high <= r.min(axis=0)[inverse] for r in reach]
    open_ = np.ones(b.count, dtype=bool) if ends else np.zeros(b.count, dtype=bool)
    for r, known in zip(reach, inside, strict=True):
        open_ |= ~known & (low <= r.max(axis=0)[inverse])
    top = int(a.ones.max())
    k = 3 if top < 255 else 2 if top < 4095 else 1
    fields = np.pad(open_, (0, -len(open_) % k)).reshape(-1, k).any(axis=1)
    mine = np.repeat(fields, k)[: b.count]
    within = [a.count * int(np.count_nonzero(known & ~mine)) for known in inside]
    if not fields.any():
        return np.inf, -np.inf, within
    c = a.flipped_in(b, None if fields.all() else np.flatnonzero(fields), k)
    # a count of three fields has a fourth byte
    place = np.flatnonzero(mine)
    column = np.arange(len(place)) if k != 3 else np.arange(len(place)) // 3 * 4 + np.arange(len(place)) % 3
    v, inverse = v[place], inverse[place]
    least, most = np.inf, -np.inf
    if ends:
        out = np.empty((2, len(a.first), c.shape[1]), dtype=c.dtype)
        for g, (s, e) in enumerate(zip(a.first, a.ends, strict=True)):
            c[s:e].max(axis=0, out=out[0, g])
            c[s:e].min(axis=0, out=out[1, g])
        h = (a.ones[:, None] + v[None, :]) - 2 * out[:, :, column].astype(np.int64)
        if estimate is not None:
            h = estimate(h.astype(np.float64), a.x[None, :, None], None if b.x is None else b.x[0][inverse][None, None, :])
        least, most = float(h[0].min()), float(h[1].max())
    for n, r in enumerate(reach):
        need = np.clip((a.ones[:, None] + v[None, :] - r[:, inverse if b.x is not None else np.zeros(len(v), dtype=np.int64)] + 1) >> 1, 0, top + 1)
        all_of = np.full((len(a.first), c.shape[1]), top + 1, dtype=c.dtype)
        all_of[:, column] = need
        within[n] += sum(int(np.count_nonzero(c[s:e] >= all_of[g])) for g, (s, e) in enumerate(zip(a.first, a.ends, strict=True)))
    return least, most, within


class _Side:
    """Kinds of records of one block, by their value: vectors, their ones, another number of each, and how many records they are."""

    def __init__(self, table: pa.Table, m: int | None):
        get = lambda c: table[c].to_numpy()
        order = np.argsort(get("_value"), kind="stable")
        self.value, self.n = get("_value")[order], get("_n")[order].astype(np.float64)
        self.x = get("_x").astype(np.float64)[order] if "_x" in table.column_names else None
        self.m = m
        if m is not None:
            packed = b"".join(v.as_py() for v in table["_vector"].combine_chunks().take(pa.array(order)))
            self.packed = np.frombuffer(packed, dtype=np.uint8).reshape(len(order), -(-m // 64) * 8)
        self.parts, self.left = list(self._cut()), {}

    def _cut(self):
        """Tiles: a value of many records is apart."""
        turns, at = (np.flatnonzero(self.value[1:] != self.value[:-1]) + 1).tolist(), 0
        runs = zip([0, *turns], [*turns, len(self.value)], strict=True)
        for s, e in [*((s, e) for s, e in runs if e - s >= ALONE), (len(self.value), len(self.value))]:
            for f, t in ((at, s), (s, e)):
                count = -(-(t - f) // TILE)
                yield from (slice(f + (t - f) * k // count, f + (t - f) * (k + 1) // count) for k in range(count))
            at = e

    def bits(self, part: slice) -> np.ndarray:
        return np.unpackbits(self.packed[part], axis=1, bitorder="little")[:, : self.m]

    def alike(self, part: slice) -> bool:
        """Has the tile one value, and is each of its records there once?"""
        return self.value[part][0] == self.value[part][-1] and self.n[part].max() == 1

    def flips(self, part: slice) -> _Left:
        if part.start not in self.left:
            self.left[part.start] = _Left(self, part)
        return self.left[part.start]

    def tile(self, part: slice) -> tuple:
        known, first = np.unique(self.value[part], return_index=True)
        vectors = None if self.m is None else self.bits(part).astype(np.float32)
        return known, first, self.n[part], None if self.x is None else self.x[part], vectors


def _meet(a: tuple, b: tuple, same: bool, estimate: Callable, limits: np.ndarray, m: int | None) -> tuple:
    """(true distance, pairs, least, most, pairs within each limit) of the classes of two tiles; of a tile with itself each pair once."""
    (va, ia, na, xa, wa), (vb, ib, nb, xb, wb) = a, b
    h = None
    if m is not None:
        one = lambda w: np.ones((len(w), 1), dtype=np.float32)
        left = np.hstack([-2 * wa, wa.sum(axis=1, keepdims=True), one(wa)])
        h = left @ np.hstack([wb, one(wb), wb.sum(axis=1, keepdims=True)]).T
    est = h if estimate is None else estimate(None if h is None else h.astype(np.float64), None if xa is None else xa[:, None], None if xb is None else xb[None, :])
    once = np.triu(np.ones(est.shape, dtype=bool), 1) if same else None
    ends = lambda f, e: f.reduceat(f.reduceat(e, ia, axis=0), ib, axis=1)
    least = ends(np.minimum, est if once is None else np.where(once, est, np.inf))
    most = ends(np.maximum, est if once is None else np.where(once, est, -np.inf))
    exact = np.float32 if na.max() == nb.max() == 1 else np.float64

    def weight(n, first):
        out = np.zeros((len(n), len(first)), dtype=exact)
        out[np.arange(len(n)), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))] = n
        return out

    ka, kb = weight(na, ia).T, weight(nb, ib)
    count = lambda mask: (ka @ mask.astype(exact) @ kb).astype(np.float64)
    total = np.outer(np.add.reduceat(na, ia), np.add.reduceat(nb, ib)) if once is None else count(once)
    within = [count(est <= t if once is None else (est <= t) & once) for t in limits]
    found = total.ravel() > 0
    return np.abs(va[:, None] - vb[None, :]).ravel()[found], total.ravel()[found], least.ravel()[found], most.ravel()[found], [w.ravel()[found] for w in within]


def distances(df: DataFrame, value: str, bits: str | None, m: int, estimate: Callable, limits: tuple[float, ...] = (), x: str | None = None, blocks: int = 6, parts: int = 4, ends: bool = True, rising: bool = False) -> DataFrame:
    """(true_dis, n, least, most, within) over all unordered pairs of records: partial sums of pairs by true distance,
    their least and largest estimate and, for each limit, how many estimates do not exceed it.

    ``estimate(h, x_a, x_b)`` is computed on arrays: Hamming distances of the vectors ``bits`` of m positions, which a matrix
    product gives for a tile of records at once, and the numbers ``x`` of both records; without ``bits`` only of the
    latter, without ``x`` only of the former.  Equal records are one, with a weight.  The rest are dealt into blocks by a
    hash of their value and into ``parts`` of these by a hash of all, and each pair of blocks is a group of its own.

    Without ``ends`` least and most are null.  If the estimate never falls as the Hamming distance grows (``rising``; found out
    if there is no ``x``), records of two values meet by their flips, see ``_meet_flips``.
    """
    keys = [F.col(value).cast("double").alias("_value")] + ([C.packed(F.col(bits), m).alias("_vector")] if bits else []) + ([F.col(x).cast("double").alias("_x")] if x else [])
    named = ["_value"] + (["_vector"] if bits else []) + (["_x"] if x else [])
    kinds = df.select(*keys).groupBy(*named).agg(F.count(F.lit(1)).alias("_n"))
    block = (F.pmod(F.xxhash64("_value"), F.lit(blocks)) * parts + F.pmod(F.xxhash64(*named), F.lit(parts))).cast("int")
    dealt = kinds.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks * parts - 1))))
    dealt = dealt.withColumns({"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")}).drop("_other")
    size, limit = (m if bits else None), np.array(limits, dtype=np.float64)
    table = None if x else estimate(np.arange(m + 1, dtype=np.float64), None, None)
    # an estimate that rises with the Hamming distance alone is looked up after the least and largest distance are known
    alone = table is not None and bool((np.diff(table) >= 0).all())
    inner = None if alone else estimate
    bounds = np.searchsorted(table, limit, side="right") - 1 if alone else limit
    shown = (lambda e: table[e.astype(np.int64)]) if alone else (lambda e: e)
    by_flips = size is not None and (alone or rising and x is not None)

    def meet(group: pa.Table) -> pa.Table:
        low, high, mine = group["_low"][0].as_py(), group["_high"][0].as_py(), group["_block"].to_numpy()
        a = _Side(group.filter(pa.array(mine == low)), size)
        b = a if low == high else _Side(group.filter(pa.array(mine == high)), size)
        out = []
        for k, j in enumerate(b.parts):
            right = None
            for i in a.parts[: k + 1] if a is b else a.parts:
                if by_flips and not (a is b and i == j) and a.alike(i) and b.alike(j):
                    right = right or _Right(b, j)
                    least, most, within = _meet_flips(a.flips(i), right, inner, bounds, size, ends)
                    one = lambda v: np.array([v], dtype=np.float64)
                    out.append((one(abs(a.value[i.start] - b.value[j.start])), one((i.stop - i.start) * (j.stop - j.start)), one(least), one(most), [one(w) for w in within]))
                else:
                    out.append(_meet(a.tile(i), b.tile(j), a is b and i == j, inner, bounds, size))
        many = np.flatnonzero(a.n > 1) if a is b else []
        if len(many):
            own = np.zeros(len(many)) if alone else estimate(None if size is None else np.zeros(len(many)), *([None, None] if a.x is None else [a.x[many]] * 2))
            n = a.n[many] * (a.n[many] - 1) / 2
            out.append((np.abs(a.value[many] - a.value[many]), n, own, own, [np.where(own <= t, n, 0.0) for t in bounds]))
        if not out:
            return pa.table({"true_dis": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), "least": pa.array([], pa.float64()), "most": pa.array([], pa.float64()), "within": pa.array([], pa.list_(pa.int64()))})
        true, n, least, most = (np.concatenate([o[k] for o in out]) for k in range(4))
        known, which = np.unique(true, return_inverse=True)
        tally = lambda v: np.bincount(which, weights=v, minlength=len(known)).astype(np.int64)
        far = [np.full(len(known), np.inf), np.full(len(known), -np.inf)]
        np.minimum.at(far[0], which, least)
        np.maximum.at(far[1], which, most)
        least, most = (pa.array(shown(e)) if ends else pa.nulls(len(known), pa.float64()) for e in far)
        within = [tally(np.concatenate([o[4][k] for o in out])) for k in range(len(bounds))]
        lists = np.stack(within, axis=1).tolist() if within else [[] for _ in known]
        return pa.table({"true_dis": pa.array(known, from_pandas=True), "n": tally(n), "least": least, "most": most, "within": pa.array(lists, pa.list_(pa.int64()))})

    tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
    return dealt.repartition(tasks, "_low", "_high").groupBy("_low", "_high").applyInArrow(meet, "true_dis double, n bigint, least double, most double, within array<bigint>")


def decided(summary: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    """(true_dis, est_dis, pairs) of ``distances`` with rising limits, each estimate raised to the next limit, or to infinity."""
    steps = [F.struct(F.lit(float(t)).alias("est_dis"), (F.get("within", k) - (F.get("within", k - 1) if k else 0)).alias("pairs")) for k, t in enumerate(limits)]
    rest = F.struct(F.lit(math.inf).alias("est_dis"), (F.col("n") - F.get("within", len(limits) - 1)).alias("pairs"))
    return summary.select("true_dis", F.inline(F.array(*steps, rest)))


def gaussian_domain(df: DataFrame, row: str, low: float, high: float, seed: str = "heights") -> DataFrame:
    """A normal value around the domain's middle, sd half of its half width, by two keyed coins; below low it is low, else the floor up to high."""
    mean = (low + high) / 2
    u, v = (B.coin(seed, F.col(row), F.lit(0), d) for d in ("radius", "angle"))
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)
    value = z * ((mean - low) / 2) + mean
    return df.select(F.col(row), F.when(value < low, F.lit(float(low))).otherwise(F.floor(F.least(value, F.lit(float(high)))).cast("double")).alias("value"))


def uniform_domain(df: DataFrame, row: str, low: float, high: float, seed: str = "ages") -> DataFrame:
    """The floor of a uniform value, by a keyed coin."""
    return df.select(F.col(row), F.floor(B.coin(seed, F.col(row), F.lit(0), "value") * (high - low) + low).cast("double").alias("value"))
