"""Column functions on strings: tokens, phonetic code, binary numerals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.functions.bits import let

PAD = "_"


def is_numeric(c: Column) -> Column:
    """Only decimal digits of any script; true for the empty string."""
    return c.rlike(r"^\p{Nd}*\z")


def qgrams(c: Column, q: int, padded: bool = False) -> Column:
    """Single characters of a number; otherwise the windows of q characters, of the padded string if asked.  Shorter strings have none."""
    s = F.concat(F.lit(PAD * (q - 1)), c, F.lit(PAD * (q - 1))) if padded else c
    windows = F.transform(F.sequence(F.lit(1), F.length(s) - q + 1), lambda i: s.substr(i, F.lit(q)))
    single = F.filter(F.split(c, ""), lambda x: x != "")
    return F.when(is_numeric(c), single).when(F.length(s) >= q, windows).otherwise(F.array().cast("array<string>"))


def record_qgrams(attrs: list[Column], q: int, padded: bool = False) -> Column:
    """The grams of all attributes, one after the other; a null attribute has none."""
    return F.flatten(F.array(*(F.coalesce(qgrams(a, q, padded), F.array().cast("array<string>")) for a in attrs)))


def counted(grams: Column) -> Column:
    """The k-th occurrence of a gram gets k as suffix, which makes the bag a set."""
    return let(grams, lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))


def salted(grams: Column, salt: Column) -> Column:
    return F.transform(grams, lambda x: F.concat(x, salt))


# The letters with a code, and their codes.
CODED, CODES = "bfpvlcgjkqsxzmndtr", "111142222222255336"


def soundex_variant(c: Column) -> Column:
    """First character as it is, then codes of the coded letters, repeats of a code collapsed, cut and filled to four."""
    s = F.lower(c)
    rest = F.regexp_replace(F.substring(s, 2, 1_000_000), f"[^{CODED}]", "")
    codes = F.concat(F.substring(s, 1, 1), F.translate(rest, CODED, CODES))
    return F.substring(F.rpad(F.regexp_replace(codes, r"([1-6])\1+", "$1"), 4, "0"), 1, 4)


def joined(values: Column) -> Column:
    """Every item followed by a comma."""
    return F.concat(F.array_join(values, ","), F.lit(","))


def split_by_type(df: DataFrame, columns: list[str], types: list[str]) -> DataFrame:
    """Columns dealt into str, int and loc arrays by their tags; an int that does not parse is null."""
    of = lambda tag: [F.col(c) for c, t in zip(columns, types, strict=True) if t == tag]
    ints = [c.try_cast("int") for c in of("int")]
    return df.withColumns({"str_attrs": F.array(*of("str")).cast("array<string>"), "int_attrs": F.array(*ints).cast("array<int>"), "loc_attrs": F.array(*of("loc")).cast("array<string>")})


def from_binary(c: Column) -> Column:
    return F.conv(c, 2, 10).cast("long")


def binary_add(a: Column, b: Column) -> Column:
    return F.bin(from_binary(a) + from_binary(b))


def binary_multiply(a: Column, by: Column) -> Column:
    return F.bin(from_binary(a) * by)


def binary_xor(a: Column, b: Column) -> Column:
    """Position by position, as long as the first; the second is filled with zeros or cut on the right."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(F.rpad(b, F.length(a), F.lit("0")), "").alias("b"))
    return F.array_join(F.transform(F.slice(pairs, F.lit(1), F.length(a)), lambda p: F.when(p["a"] == p["b"], "0").otherwise("1")), "")


def binary_mod(a: Column, by: Column) -> Column:
    """Remainder of the integers, in binary; null for a zero divisor."""
    return F.bin(F.when(by != 0, from_binary(a) % by))


def gf2_mod(a: Column, divisor: int) -> Column:
    """Remainder of the polynomial over GF(2) whose coefficients are the bits, in binary without leading zeros."""
    top = divisor.bit_length() - 1
    if top < 1:
        return F.lit("0")
    step = lambda acc, x: F.when(F.shiftright(acc.bitwiseOR(F.lit(0).cast("long")), top - 1).bitwiseAND(F.lit(1)) == 1, (F.shiftleft(acc, 1).bitwiseOR(x)).bitwiseXOR(F.lit(divisor).cast("long"))).otherwise(F.shiftleft(acc, 1).bitwiseOR(x))
    return F.bin(F.aggregate(F.transform(F.split(a, ""), lambda x: x.cast("long")), F.lit(0).cast("long"), step))
