"""SQL fragments that the oracle queries are put together from."""

from __future__ import annotations

from lumenlink.functions.hashing import LOW31, hmac_pads


def grams(c: str, q: int, padded: bool = False) -> str:
    s = f"('{'_' * (q - 1)}' || {c} || '{'_' * (q - 1)}')" if padded else c
    return (
        f"(CASE WHEN regexp_full_match({c}, '\\p{{Nd}}*') THEN list_filter(string_split({c}, ''), lambda x: x <> '') "
        f"WHEN length({s}) >= {q} THEN list_transform(range(1, length({s}) - {q} + 2), lambda i: substr({s}, i, {q})) ELSE CAST([] AS VARCHAR[]) END)"
    )


def record_grams(attrs: list[str], q: int) -> str:
    return "list_concat(" + ", ".join(grams(a, q) for a in attrs) + ")" if len(attrs) > 1 else grams(attrs[0], q)


def low32(hex_digest: str) -> str:
    return f"CAST('0x' || right({hex_digest}, 8) AS BIGINT)"


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320, by its rule."""
    out = []
    for v in range(256):
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def crc32(g: str) -> str:
    """CRC-32 of an ASCII string."""
    codes = f"list_transform(range(1, length({g}) + 1), lambda i: CAST(unicode(substr({g}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda v, x: xor(v >> 8, CAST({listed(_crc_table())} AS BIGINT[])[(xor(v, x) & 255) + 1])), 4294967295)"


def double_hash(g: str, k: int, n: int) -> str:
    return f"list_transform(range(1, {k + 1}), lambda i: (({low32(f'sha1({g})')} + i * {low32(f'md5({g})')}) & {LOW31}) % {n})"


def hmac(g: str, key: str, f: str) -> str:
    inner, outer = hmac_pads(key, f)
    return f"{f}(unhex('{outer}') || unhex({f}(unhex('{inner}') || encode({g}))))"


def big_mod(h: str, digits: int, n: int) -> str:
    acc = "0"
    for at in range(1, digits + 1, 8):
        acc = f"(({acc}) * 4294967296 + CAST('0x' || substr({h}, {at}, 8) AS BIGINT)) % {n}"
    return acc


def soundex(c: str) -> str:
    code = f"substr(lower({c}), 1, 1) || translate(regexp_replace(substr(lower({c}), 2), '[^bfpvlcgjkqsxzmndtr]', '', 'g'), 'bfpvlcgjkqsxzmndtr', '111142222222255336')"
    for d in "123456":
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    return f"substr(rpad({code}, 4, '0'), 1, 4)"


def shown(bits: str) -> str:
    return f"array_to_string({bits}, ' ')"


def odd(positions: str) -> str:
    return f"list_sort(list_filter(list_distinct({positions}), lambda p: len(list_filter({positions}, lambda x: x = p)) % 2 = 1))"


def coin(seed: str, row: str, bit: str, draw: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST({row} AS VARCHAR), CAST({bit} AS VARCHAR), '{draw}')), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"


def listed(values) -> str:
    return "[" + ", ".join(listed(v) if isinstance(v, (list, tuple)) else repr(v) for v in values) + "]"


def bit_string(positions: str, n: int) -> str:
    """A BIT value of n bits."""
    return f"CAST(array_to_string(list_transform(range(0, {n}), lambda p: CASE WHEN list_contains({positions}, p) THEN '1' ELSE '0' END), '') AS BIT)"
