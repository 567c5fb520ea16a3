"""Candidate generation: block keys of records in long form (entity_id, block_key)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions.hashing import low32
from lumenlink.functions.jrandom import JavaRandom, coefficients
from lumenlink.functions.text import soundex_variant

PRIME = 4294967311


def none_key() -> Column:
    return F.lit("all")


def soundex_key(attr: Column) -> Column:
    return soundex_variant(attr)


def sampled_positions(keys: int, bits_a_key: int, n: int, seed: int = 42) -> list[list[int]]:
    r = JavaRandom(seed)
    return [[r.next_int(n) for _ in range(bits_a_key)] for _ in range(keys)]


def hlsh_random_keys(bits: Column, samples: list[list[int]]) -> Column:
    """For each sample its number and the bits at its positions."""
    table = F.array(*(F.array(*(F.lit(p) for p in s)) for s in samples))
    one = lambda b: F.transform(table, lambda s, k: F.concat(k.cast("string"), F.lit(":"), F.array_join(F.transform(s, lambda p: B.is_set(b, p).cast("int").cast("string")), "")))
    return B.let(bits, one)


def hlsh_segment_keys(bits: Column, n: int, segments: int) -> Column:
    """For each of the equal segments its number and its set positions."""
    size = n // segments
    one = lambda b: F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: F.concat(s.cast("string"), F.lit(":"), F.array_join(F.filter(b, lambda p: F.floor(p / size) == s).cast("array<string>"), ",")))
    return B.let(bits, one)


def hlsh_random_codes(samples: list[list[int]]) -> Callable:
    """As hlsh_random_keys, for rows of booleans: bytes of the bits of each sample."""
    at = np.array(samples)
    return lambda bits: np.packbits(bits[:, at], axis=2)


def hlsh_segment_codes(n: int, segments: int) -> Callable:
    """As hlsh_segment_keys, for rows of booleans."""
    size = n // segments
    return lambda bits: np.packbits(bits[:, : size * segments].reshape(len(bits), segments, size), axis=2)


def minhash(grams: Column, functions: int, base: str = "crc32", seed: int = 42) -> Column:
    """The least (a x + b) mod 4294967311 over the distinct grams, for each pair of coefficients; null without grams."""
    a, b = coefficients(functions, seed)
    x = F.transform(F.array_distinct(grams), lambda g: F.crc32(F.encode(g, "UTF-8")) if base == "crc32" else low32(F.md5(F.encode(g, "UTF-8"))))
    table = F.array(*(F.struct(F.lit(p).cast("long").alias("a"), F.lit(q).cast("long").alias("b")) for p, q in zip(a, b, strict=True)))
    sig = B.let(x, lambda v: F.transform(table, lambda t: F.array_min(F.transform(v, lambda y: (t["a"] * y + t["b"]) % PRIME))))
    return F.when(F.size(grams) > 0, sig)


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """For each band its number and a digest of its values."""
    one = lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.concat(k.cast("string"), F.lit(":"), F.md5(F.array_join(F.slice(s, k * rows + 1, F.lit(rows)).cast("array<string>"), ","))))
    return B.let(signature, one)


def blocks(df: DataFrame, keys: Column, entity: str = "entity_id") -> DataFrame:
    """Long form, each key of a record once, without a shuffle; records without keys are in no block."""
    return df.select(F.col(entity), F.explode(F.array_distinct(keys)).alias("block_key"))


def block_stats(block_table: DataFrame, large: int = 100) -> DataFrame:
    """One row: number of blocks, least, mean and largest size, blocks of one record and above ``large``."""
    sizes = block_table.groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.min("n").alias("min_size"),
        F.round(F.avg("n"), 6).alias("avg_size"),
        F.max("n").alias("max_size"),
        F.count_if(F.col("n") == 1).alias("n_single"),
        F.count_if(F.col("n") > large).alias("n_large"),
    )


def s_curve(bands: int, rows: int) -> tuple[float, list[tuple[float, float]]]:
    """The threshold (1 / bands) ** (1 / rows) and the chance of a shared band at similarities 0, 0.1 .. 0.9."""
    return (1 / bands) ** (1 / rows), [(s / 10, 1 - (1 - (s / 10) ** rows) ** bands) for s in range(10)]
