"""Record encoders: grams to Bloom filters, as sorted bit positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions import hashing as H
from lumenlink.functions.jrandom import JavaRandom


def clk(grams: Column, k: int, n: int, hashes: str = "dh") -> Column:
    """One filter over all grams of a record."""
    positions = H.family(hashes)
    return B.normal(F.flatten(F.transform(F.array_distinct(grams), lambda g: positions(g, k, n))))


def rbf(grams_by_attr: list[Column], k: int, n: int, hashes: str = "dh", seed: int = 42) -> Column:
    """One filter of n / attributes bits for each attribute, laid end to end, then permuted by a seeded shuffle."""
    each = n // len(grams_by_attr)
    positions = H.family(hashes)
    parts = [F.flatten(F.transform(F.array_distinct(g), lambda x: positions(x, k, each))) for g in grams_by_attr]

    def shifted(part: Column, by: int) -> Column:
        return F.transform(part, lambda x: x + by)

    joined = F.flatten(F.array(*(shifted(p, a * each) for a, p in enumerate(parts))))
    return permuted(joined, JavaRandom(seed).permutation(each * len(parts)))


def permuted(positions: Column, order: list[int]) -> Column:
    """Bit i of the result is bit order[i]."""
    inverse = [0] * len(order)
    for i, p in enumerate(order):
        inverse[p] = i
    table = F.array(*(F.lit(i) for i in inverse))
    return B.let(table, lambda t: B.normal(F.transform(positions, lambda p: F.get(t, p.cast("int")))))


def optimal_k(left: DataFrame, right: DataFrame, grams: str, n: int) -> DataFrame:
    """One row: round(ln 2 * n / mean grams a record over both sets), halves up."""
    sizes = left.select(F.size(grams).alias("s")).unionByName(right.select(F.size(grams).alias("s")))
    return sizes.agg(F.floor(F.lit(math.log(2)) * n / F.avg("s") + 0.5).cast("long").alias("k"))
