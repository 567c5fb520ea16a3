"""The public 48-bit linear congruential generator of the Java class library, for shared seeded draws."""

from __future__ import annotations

_MASK = (1 << 48) - 1
MULTIPLIER, INCREMENT = 0x5DEECE66D, 0xB


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ MULTIPLIER) & _MASK

    def bits(self, n: int) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) & _MASK
        value = self.state >> (48 - n)
        return value - (1 << n) if value >> (n - 1) and n == 32 else value

    def next_int(self, bound: int) -> int:
        value = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * value) >> 31
        while value - value % bound + bound - 1 >= 1 << 31:
            value = self.bits(31)
        return value % bound

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def permutation(self, n: int) -> list[int]:
        """0..n-1 as a seeded shuffle leaves it."""
        out = list(range(n))
        for k in range(n, 1, -1):
            j = self.next_int(k)
            out[k - 1], out[j] = out[j], out[k - 1]
        return out


def pair_draws(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """n pairs of positions below n, drawn one after the other."""
    r = JavaRandom(seed)
    return [(r.next_int(n), r.next_int(n)) for _ in range(n)]


def coefficients(count: int, seed: int = 42, below: int = (1 << 31) - 1) -> tuple[list[int], list[int]]:
    """Two lists of distinct draws below ``below``, each in the order of a hash set with 256 buckets (for 160 entries)."""
    r = JavaRandom(seed)
    out = []
    for _ in range(2):
        drawn: list[int] = []
        while len(drawn) < count:
            v = r.next_int(below)
            if v not in drawn:
                drawn.append(v)
        buckets = 16
        while count > buckets * 0.75:
            buckets *= 2
        out.append(sorted(drawn, key=lambda v: (v ^ (v >> 16)) & (buckets - 1)))
    return out[0], out[1]
