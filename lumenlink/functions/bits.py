"""Bit vectors: sorted positions (array<int>) for interchange, 64-bit words for pairwise kernels, keyed coins for noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(positions: Column) -> Column:
    """Distinct positions in ascending order."""
    return F.sort_array(F.array_distinct(positions)).cast("array<int>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def odd(positions: Column) -> Column:
    """Positions that occur once, of an array in which each occurs once or twice: the exclusive or of single bits."""
    lone = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) != x, F.lit(True)) & F.coalesce(F.get(s, i + 1) != x, F.lit(True)))
    return let(F.array_sort(positions), lone).cast("array<int>")


def shown(positions: Column) -> Column:
    return F.array_join(positions.cast("array<string>"), " ")


def word(positions: Column, k: int) -> Column:
    """The k-th 64-bit word."""
    mine = F.filter(positions, lambda p: F.shiftright(p, 6) == k)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(_bit(p)))


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))


def words(positions: Column, n: int, prefix: str = "w") -> dict[str, Column]:
    return {f"{prefix}{k}": word(positions, k) for k in range(-(-n // 64))}


def word_array(positions: Column, n: int) -> Column:
    """The words of a vector as an array, for tests of many positions."""
    return F.array(*(word(positions, k) for k in range(-(-n // 64))))


def has(packed: Column, p: Column) -> Column:
    """Is position p set in an array of words?"""
    return F.getbit(F.get(packed, F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1


def common(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(x.bitwiseAND(y)) for x, y in zip(left, right, strict=True))).cast("long")


def hamming(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True))).cast("long")


def dice(both: Column, ones_left: Column, ones_right: Column) -> Column:
    """2 |a & b| / (|a| + |b|), null for two empty vectors."""
    return F.try_divide(both.cast("double") * 2.0, (ones_left + ones_right).cast("double"))


def coin(seed: str, row: Column, bit: Column, draw: str) -> Column:
    """A uniform number in [0, 1) that depends on the seed, the record, the bit and the draw alone.

    Differential privacy needs a secret seed.
    """
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), row.cast("string"), bit.cast("string"), F.lit(draw))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def every(n: int) -> Column:
    """All positions below n."""
    return F.sequence(F.lit(0), F.lit(n - 1))


def chosen(n: int, keep) -> Column:
    """The positions below n for which ``keep`` (a function of the position) is true."""
    return F.filter(every(n), keep)


def is_set(positions: Column, p: Column) -> Column:
    return F.array_contains(positions, p)
