"""Hardening: bit vector to bit vector, and a registry by configuration name.

Noise draws keyed coins (functions/coins.py), so a retried task draws the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions import coins as C
from lumenlink.functions.jrandom import JavaRandom, pair_draws

SEED = "coins"


def balance(bits: Column, n: int, seed: int = 42) -> Column:
    """Each bit and its complement, in 2 n bits, permuted; n of them are set."""
    order = np.array(JavaRandom(seed).permutation(2 * n))
    return C.mapped(bits, n, lambda was: np.hstack([was, ~was])[:, order])


def xor_fold(bits: Column, n: int) -> Column:
    """The two halves' exclusive or, n / 2 bits."""
    half = n // 2

    def fold(was):
        out = np.zeros((len(was), half), dtype=bool)
        for at in range(0, n if half else 0, half or 1):
            part = was[:, at : at + half]
            out[:, : part.shape[1]] ^= part
        return out

    return C.mapped(bits, n, fold)


def rule90(bits: Column, n: int) -> Column:
    """Each bit becomes the exclusive or of its two neighbours, in a circle."""
    return C.mapped(bits, n, lambda was: np.roll(was, 1, axis=1) ^ np.roll(was, -1, axis=1))


def wxor(bits: Column, n: int) -> Column:
    """In-place exclusive or with the next bit, from the first to the last, which sees the new first."""
    return B.let(bits, lambda b: _wxor(b, n))


def _wxor(b: Column, n: int) -> Column:
    circle = B.odd(F.concat(b, F.transform(b, lambda p: (p + n - 1) % n)))
    toggled = lambda c: F.when(~B.is_set(b, F.lit(1)), c).when(B.is_set(c, F.lit(n - 1)), F.filter(c, lambda p: p != n - 1)).otherwise(F.concat(c, F.array(F.lit(n - 1))))
    return B.let(circle, toggled)


def resample_xor(bits: Column, n: int, seed: int = 42) -> Column:
    """Bit i becomes the exclusive or of the i-th seeded pair of bits."""
    takers: list[list[int]] = [[] for _ in range(n)]
    for i, pair in enumerate(pair_draws(n, seed)):
        for p in pair:
            takers[p].append(i)
    table = F.array(*(F.array(*(F.lit(i) for i in t)).cast("array<int>") for t in takers))
    return B.let(table, lambda t: B.odd(F.flatten(F.transform(bits, lambda p: F.get(t, p)))))


def blip(bits: Column, n: int, row: Column, prob: float, seed: str = SEED) -> Column:
    """Each bit is replaced by a fair coin with the given probability."""
    return C.noisy(bits, n, row, lambda was, coins: C.replaced(was, coins, prob), seed)


def uldp(bits: Column, n: int, row: Column, epsilon: float = 1.0, seed: str = SEED) -> Column:
    """Ones stay, zeros become one with probability exp(-epsilon)."""
    return C.noisy(bits, n, row, C.response(math.exp(-epsilon)), seed)


def bit_frequency(df: DataFrame, bits: str, n: int) -> DataFrame:
    """(bit, freq) for all n positions."""
    counts = df.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("freq"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bit")).join(counts, "bit", "left").select("bit", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def secret_split(frequencies: DataFrame, n: int, ratio: float) -> DataFrame:
    """(bit, freq, secret): the round(ratio n) rarest bits, of equals the later first, are not secret.  One row per bit."""
    rank = F.row_number().over(W.orderBy(F.col("freq").asc(), F.col("bit").desc()))
    return frequencies.select("bit", "freq", (rank > int(math.floor(ratio * n + 0.5))).alias("secret"))


def frequency_groups(frequencies: DataFrame, n: int, groups: int) -> DataFrame:
    """(bit, freq, grp): groups of floor(n / groups) bits by rising frequency, then bit; what is left over has none."""
    rank = F.row_number().over(W.orderBy("freq", "bit")) - 1
    size = n // groups
    return frequencies.select("bit", "freq", F.when(rank < size * groups, F.floor(rank / size).cast("int")).alias("grp"))


def _with_codes(df: DataFrame, by_bit: DataFrame, code: Column, name: str) -> DataFrame:
    """One row's small numbers, two bytes for each bit, as long as the filter, beside every record."""
    coded = by_bit.select("bit", F.lpad(F.hex(code.cast("long")), 4, "0").alias("code"))
    listed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bit", "code"))), lambda s: s["code"]), ""))
    return df.crossJoin(F.broadcast(coded.agg(listed.alias(name))))


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column[0].as_py(), dtype=">u2").astype(np.int64)


def urap_parameters(epsilon: float) -> tuple[float, float, float]:
    theta = math.exp(epsilon / 2) / (math.exp(epsilon / 2) + 1)
    return theta, 1 - theta, math.exp(-epsilon / 2)


def urap(df: DataFrame, bits: str, n: int, row: str, ratio: float, epsilon: float, out: str = "hardened", seed: str = SEED) -> DataFrame:
    """Secret bits answer one with probability theta if set and d1 if not; other bits stay zero, and ones stay with probability 1 - d2."""
    theta, d1, d2 = urap_parameters(epsilon)
    held = _with_codes(df, secret_split(bit_frequency(df, bits, n), n, ratio), F.col("secret"), "_secret")

    def keep(was, coins, secret):
        u = coins.grid(np.arange(n), "response")
        hidden = u < np.where(was, C.below(theta), C.below(d1))
        return np.where(_codes(secret) == 1, hidden, was & (u < C.below(1 - d2)))

    return held.withColumn(out, C.noisy(F.col(bits), n, F.col(row), keep, seed, F.col("_secret"))).drop("_secret")


def urap_prob(df: DataFrame, bits: str, n: int, row: str, ratio: float, secret_prob: float, plain_prob: float, out: str = "hardened", seed: str = SEED) -> DataFrame:
    """As urap with given probabilities: secret bits are replaced by a coin with one, set bits of the others with the other."""
    held = _with_codes(df, secret_split(bit_frequency(df, bits, n), n, ratio), F.col("secret"), "_secret")

    def keep(was, coins, secret):
        hidden = _codes(secret) == 1
        return C.replaced(was, coins, np.where(hidden, secret_prob, plain_prob), hidden[None, :] | was)

    return held.withColumn(out, C.noisy(F.col(bits), n, F.col(row), keep, seed, F.col("_secret"))).drop("_secret")


def indexed(df: DataFrame, bits: str, n: int, row: str, probs: list[float], out: str = "hardened", seed: str = SEED) -> DataFrame:
    """Bits of the g-th frequency group are replaced by a coin with the g-th probability; left-over bits stay."""
    groups = frequency_groups(bit_frequency(df, bits, n), n, len(probs))
    held = _with_codes(df, groups, F.coalesce("grp", F.lit(len(probs))), "_grp")
    table = np.array([*probs, 0.0], dtype=np.float64)
    return held.withColumn(out, C.noisy(F.col(bits), n, F.col(row), lambda was, coins, grp: C.replaced(was, coins, table[_codes(grp)]), seed, F.col("_grp"))).drop("_grp")


def compress(bits: Column, n: int, ratio: float, seed: int = 42) -> Column:
    """Drop ratio n positions, one of each of as many disjoint seeded pairs: the unset one, or the larger of equals; the rest close up."""
    order = JavaRandom(seed).permutation(n)
    pairs = [(min(a, b), max(a, b)) for a, b in zip(order[::2], order[1::2], strict=False)][: int(n * ratio)]
    low, high = (F.array(*(F.lit(p[k]) for p in pairs)) for k in (0, 1))

    def closed(b):
        dropped = F.array_sort(B.let(B.word_array(b, n), lambda w: F.zip_with(low, high, lambda x, y: F.when(B.has(w, y) & ~B.has(w, x), x).otherwise(y))))
        return B.let(dropped, lambda d: F.transform(F.array_except(b, d), lambda p: (p - F.size(F.filter(d, lambda x: x < p))).cast("int")))

    return B.let(bits, closed)


def harden(df: DataFrame, bits: str, n: int, row: str, config: str, out: str = "hardened") -> tuple[DataFrame, int]:
    """Apply a hardening by its configuration name, such as none, bal, xor, r90, blip-0.1, wxor-1, rexor, uldp-1, urap-0.5-1, indexd-0.1-0.2; gives the new length too.

    Names are taken in any case; rxor stands for rexor; an unknown name is an error.
    """
    name, *args = config.lower().split("-")
    c, r, a = F.col(bits), F.col(row), [float(x) for x in args]
    simple = {"none": lambda: (c, n), "salt": lambda: (c, n), "bal": lambda: (balance(c, n), 2 * n), "xor": lambda: (xor_fold(c, n), n // 2), "r90": lambda: (rule90(c, n), n), "blip": lambda: (blip(c, n, r, a[0]), n), "wxor": lambda: (wxor(c, n), n), "rexor": lambda: (resample_xor(c, n), n), "rxor": lambda: (resample_xor(c, n), n), "uldp": lambda: (uldp(c, n, r, *a), n)}
    if name in simple:
        column, length = simple[name]()
        return df.withColumn(out, column), length
    if name == "urap":
        return urap(df, bits, n, row, a[0], a[1], out), n
    if name == "indexd":
        return indexed(df, bits, n, row, a, out), n
    raise ValueError(f"unknown hardening {config!r}; known: {', '.join(simple)}, urap, indexd")
