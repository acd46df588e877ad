"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's str.split() white space, as a Java character class (fixed values of the Unicode standard).
WS = r"[\x09-\x0d\x1c-\x1f\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def letters_digits(c: Column) -> Column:
    """Lower case, letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def spaced_letters_digits(c: Column) -> Column:
    """Lower case, every run of other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def pieces(c: Column) -> Column:
    """The pieces between white space, as an array; an empty text has none."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def clean_key(c: Column) -> Column:
    """Trimmed and lower case; blank becomes null."""
    t = F.lower(F.regexp_replace(c, f"^{WS}+|{WS}+$", ""))
    return F.when(t != "", t)


def let(value: Column, use) -> Column:
    """use(value), with value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
