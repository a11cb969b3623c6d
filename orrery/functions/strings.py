"""Strings and bit strings as Spark columns. Positions count from 1; a bit string is text of 0, 1 and, in patterns, x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.numeric import _c


def stripped(s, null: str | None = None) -> Column:
    """Without blanks at the end; NULL where that leaves the column's null text."""
    out = F.rtrim(_c(s))
    return out if null is None else F.when(out != null, out)


def join(*parts) -> Column:
    """Concatenation; NULL if any part is."""
    return F.concat(*map(_c, parts))


def middle(s, start, length) -> Column:
    """Part of a text; NULL from position 0, empty beyond the end."""
    start = _c(start)
    return F.when(start != 0, F.substring(_c(s), start, _c(length)))


def find(s, part) -> Column:
    """Where a part first stands; NULL if nowhere."""
    return F.nullif(F.instr(_c(s), part) if isinstance(part, str) else F.locate(part, _c(s)), F.lit(0))


def _wide(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.lpad(a, n, "0"), F.lpad(b, n, "0")


def _each(a, b, one) -> Column:
    a, b = _wide(_c(a), _c(b))
    return F.array_join(F.zip_with(F.split(a, "(?<=.)(?=.)"), F.split(b, "(?<=.)(?=.)"), one), "")


def bits_literal(text: str) -> Column:
    """b101x, o17 (three bits a digit) or hFF (four bits a digit) as a bit string; x or X stands for any bit."""
    base = {"b": 1, "o": 3, "h": 4}.get(text[:1].lower())
    digits = text[1:].lower()
    if not base or not digits or any(c != "x" and (c not in "0123456789abcdef" or int(c, 16) >> base) for c in digits):
        raise ValueError(f"not a bit string: {text!r}")
    return F.lit("".join("x" * base if c == "x" else f"{int(c, 16):0{base}b}" for c in digits))


def bits_and(a, b) -> Column:
    return _each(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))


def bits_or(a, b) -> Column:
    return _each(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"))


def bits_not(a) -> Column:
    return F.translate(_c(a), "01", "10")


def bits_equal(a, pattern) -> Column:
    """Equality from the right, x in either fits both."""
    return ~F.coalesce(F.array_contains(F.split(_each(a, pattern, lambda x, y: F.when((x == "x") | (y == "x") | (x == y), "1").otherwise("0")), "(?<=.)(?=.)"), "0"), F.lit(False))


def bits_less(a, b) -> Column:
    """Order as numbers, over the places where neither has x."""
    masked = lambda p, q: _each(p, q, lambda x, y: F.when((x == "x") | (y == "x"), "0").otherwise(x))
    a, b = _c(a), _c(b)
    return masked(a, b) < masked(b, a)


def bits_count(a) -> Column:
    return F.char_length(F.translate(_c(a), "0x", "")).cast("long")


def bit(a, i) -> Column:
    return F.substring(_c(a), _c(i), F.lit(1))


def bits_of(n, width: int) -> Column:
    """The lowest bits of a whole number, first the highest."""
    return F.right(F.lpad(F.bin(_c(n)), width, "0"), F.lit(width))
