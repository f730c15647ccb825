"""Arithmetic that differs from Spark's: rounding, integer division, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division, truncated towards zero."""
    return F.call_function("div", a, b)


def to_int(x: Column, kind: str = "int") -> Column:
    """A float as an integer: rounded half to even, an error out of range."""
    return F.bround(x).cast(kind)


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    return F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(n))


def bits(x: Column, width: int) -> Column:
    """An integer as a bit string of ``width``."""
    return F.lpad(F.right(F.bin(x), F.lit(width)), width, "0")


def from_bits(text: Column) -> Column:
    return F.conv(text, 2, 10).cast("long")


def bit_shift(text: Column, width: int, by: int) -> Column:
    """A bit string moved left, or right for negative ``by``; its width stays."""
    zeros = F.lit("0" * min(abs(by), width))
    moved = F.concat(F.substring(text, by + 1, width), zeros) if by >= 0 else F.concat(zeros, text)
    return F.substring(moved, 1, width)


def factorial(x: Column) -> Column:
    return F.factorial(x)


def money(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x), 2))


def trunc_to(x: Column, n: int) -> Column:
    """Digits behind the n-th go, towards zero."""
    scaled = x.cast("decimal(28,10)") * F.lit(10**n).cast("decimal(10,0)") if n >= 0 else x.cast("decimal(28,10)") / F.lit(10**-n).cast("decimal(10,0)")
    whole = F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("decimal(28,0)")
    return (whole / F.lit(10**n).cast("decimal(10,0)")).cast("double") if n >= 0 else (whole * F.lit(10**-n).cast("decimal(10,0)")).cast("double")


def round_to(x: Column, n: int) -> Column:
    """Rounded half away from zero, as decimals are."""
    return F.round(x.cast("decimal(28,10)"), n)


def log_to_base(base: Column, x: Column) -> Column:
    return F.ln(x) / F.ln(base)


def to_char(x: Column, pattern: str) -> Column:
    """A number by a pattern of ``9 0 , .`` with FM in front or MI behind; too
    many digits give ``#``."""
    fill, after = pattern.startswith("FM"), pattern.endswith("MI")
    body = pattern.removeprefix("FM").removesuffix("MI")
    whole, _, fraction = body.partition(".")
    digits = F.format_number(F.abs(round_to(x, len(fraction))), len(fraction))
    if "," not in whole:
        digits = F.replace(digits, F.lit(","), F.lit(""))
    if "0" not in whole:
        digits = F.regexp_replace(digits, r"^0(?=\.)", "")
    elif "," not in whole:
        digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(len(body) - whole.index("0"))), F.lit("0"))
    digits = F.when(F.length(digits) > len(body), F.lit("".join("#" if c in "90" else c for c in body))).otherwise(digits)
    minus = F.when(x < 0, "-").otherwise("" if fill else " ")
    if after:
        return F.concat(digits if fill else F.lpad(digits, len(body), " "), minus)
    return F.concat(minus, digits) if fill else F.lpad(F.concat(minus, digits), len(body) + 1, " ")


def to_number(text: Column, pattern: str) -> Column:
    """The number in a text of such a pattern; blanks, commas and signs of
    money are passed over."""
    places = len(pattern.partition(".")[2].replace("MI", ""))
    digits = F.regexp_replace(text, r"[^0-9.]", "").cast(f"decimal(28,{places})")
    return F.when(F.contains(text, F.lit("-")), -digits).otherwise(digits)


def bit_and(a: Column, b: Column) -> Column:
    """Of two bit strings of one length; others are an error."""
    return _bitwise(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: x.bitwiseXOR(y))


def _bitwise(a: Column, b: Column, how) -> Column:
    found = F.lpad(F.bin(how(from_bits(a), from_bits(b))), F.length(a), F.lit("0"))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("bit strings of different sizes"))).otherwise(found)


def money_times(cents: Column, factor: Column) -> Column:
    """An amount in cents times a number, to the nearest cent."""
    return F.round(cents * factor).cast("long")
