"""Digests of grams and the bit positions that they give in a filter of n bits."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlink.functions.bits import let
from lumenlink.functions.jrandom import INCREMENT, MULTIPLIER

LOW31 = 2147483647
_DIGEST = {"sha1": F.sha1, "md5": F.md5}


def digest(c: Column, algorithm: str = "sha1") -> Column:
    """Hex digest of the UTF-8 bytes."""
    return _DIGEST[algorithm](F.encode(c, "UTF-8"))


def keyed(c: Column, key: str, algorithm: str = "sha1") -> Column:
    return digest(F.concat(F.lit(key), c), algorithm)


def hmac_pads(key: str, algorithm: str) -> tuple[str, str]:
    """The key xor the inner and the outer pad, as hex."""
    k = key.encode()
    k = (hashlib.new(algorithm, k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


def hmac_digest(c: Column, key: str, algorithm: str = "sha1") -> Column:
    """Hex HMAC; the plain digest for an empty key."""
    if not key:
        return digest(c, algorithm)
    inner, outer = hmac_pads(key, algorithm)
    f = _DIGEST[algorithm]
    return f(F.concat(F.unhex(F.lit(outer)), F.unhex(f(F.concat(F.unhex(F.lit(inner)), F.encode(c, "UTF-8"))))))


def hmac_python(text: str, key: str, algorithm: str = "sha1") -> str:
    return hmac.new(key.encode(), text.encode(), algorithm).hexdigest()


def low32(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, -8, 8), 16, 10).cast("long")


def _rounds(k: int, start: int) -> Column:
    return F.array(*(F.lit(i).cast("long") for i in range(start, start + k)))


def double_hash(g: Column, k: int, n: int) -> Column:
    both = F.struct(low32(digest(g)).alias("one"), low32(digest(g, "md5")).alias("two"))
    return let(both, lambda h: F.transform(_rounds(k, 1), lambda i: (h["one"] + i * h["two"]).bitwiseAND(F.lit(LOW31)) % n))


def enhanced_double_hash(g: Column, k: int, n: int) -> Column:
    """s + C(i + 2, 4) for i = 1..k, s the low 31 bits of the sum of both digests; saturated at 2**31 - 1."""
    s = (low32(digest(g)) + low32(digest(g, "md5"))).bitwiseAND(F.lit(LOW31))
    steps = F.array(*(F.lit((i + 2) * (i + 1) * i * (i - 1) // 24).cast("long") for i in range(1, k + 1)))
    return let(s, lambda v: F.transform(steps, lambda c: F.least(v + c, F.lit(LOW31).cast("long")) % n))


def _next_state(v: Column) -> Column:
    high, low = F.shiftright(v, 24), v.bitwiseAND(F.lit((1 << 24) - 1))
    m = F.lit(MULTIPLIER).cast("long")
    return ((high * m).bitwiseAND(F.lit((1 << 24) - 1)) * (1 << 24) + low * m + INCREMENT).bitwiseAND(F.lit((1 << 48) - 1))


def random_hash(g: Column, k: int, n: int) -> Column:
    """k draws below n of a generator seeded by the digest; n is no power of two.

    The generator redraws with a probability below n / 2**31, which is left out.
    """
    seed = low32(digest(g)).bitwiseAND(F.lit(LOW31)).bitwiseXOR(F.lit(MULTIPLIER).cast("long"))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(seed), lambda acc, i: F.concat(acc, F.array(_next_state(F.element_at(acc, -1)))))
    return F.transform(F.slice(states, 2, k), lambda v: F.shiftright(v, 17) % n)


def big_mod(hex_digest: Column, digits: int, n: int) -> Column:
    """A long hex number modulo n, eight digits at a time."""

    def fold(h: Column) -> Column:
        acc = F.lit(0).cast("long")
        for at in range(1, digits + 1, 8):
            acc = (acc * (1 << 32) + F.conv(F.substring(h, at, 8), 16, 10).cast("long")) % n
        return acc

    return let(hex_digest, fold)


def hmac_hash(g: Column, k: int, n: int, key: str = "bloomfilter") -> Column:
    """(h1 + i h2) mod n for i = 0..k-1 on the full HMAC digests."""
    both = F.struct(big_mod(hmac_digest(g, key, "sha1"), 40, n).alias("one"), big_mod(hmac_digest(g, key, "md5"), 32, n).alias("two"))
    return let(both, lambda h: F.transform(_rounds(k, 0), lambda i: (h["one"] + i * h["two"]) % n))


FAMILIES = {"dh": double_hash, "edh": enhanced_double_hash, "rh": random_hash, "hmac": hmac_hash}


def family(name: str):
    """The hash family of a configuration name, in any case; unknown names are an error."""
    try:
        return FAMILIES[name.lower().split("-")[0]]
    except KeyError:
        raise ValueError(f"unknown hash family {name!r}; known: {', '.join(FAMILIES)}") from None
