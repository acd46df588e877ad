"""Language and spelling classes by rule, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkraal import lexicons as lx
from textkraal.functions.normalize import WS, let, pieces

WORD = r"[\p{L}\p{Nl}\p{No}]+(?:[-'][\p{L}\p{Nl}\p{No}]+)*"


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; null text has none."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def among(words: Column, lexicon: list[str]) -> Column:
    """How many of the words are in the lexicon."""
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def language_v1(text: Column) -> Column:
    """TARGET/MIXED/FOREIGN_LANGUAGE or UNCERTAIN by shares of listed words; null and short texts are UNCERTAIN."""
    w = found(F.lower(text), r"[a-zA-Z\x{c0}-\x{17f}]+")
    n = F.greatest(F.size(w), F.lit(1))
    e, x = among(w, lx.ENGLISH_V1) / n, among(w, lx.XHOSA_V1) / n
    return (
        F.when(F.size(w) < 3, "UNCERTAIN").when((e > 0.3) & (x < 0.1), "FOREIGN_LANGUAGE").when((e > 0.15) & (x > 0.05), "MIXED_LANGUAGE")
        .when((x > 0.05) | (e < 0.15), "TARGET_LANGUAGE").otherwise("UNCERTAIN")
    )


def language_v2(text: Column) -> Column:
    """The second rule: phrases by pattern, other thresholds; UNCERTAIN only for short texts."""
    w = found(F.lower(text), "[a-zA-Z]+")
    n = F.greatest(F.size(w), F.lit(1))
    phrase = r"(?i)\b(" + "|".join(lx.XHOSA_V2) + r")\b"
    x, e = F.size(found(text, phrase)) / n, among(w, lx.ENGLISH_V2) / n
    return (
        F.when(F.size(w) < 3, "UNCERTAIN").when((e > 0.4) & (x < 0.05), "FOREIGN_LANGUAGE")
        .when((x > 0.01) | (e < 0.2), "TARGET_LANGUAGE").otherwise("MIXED_LANGUAGE")
    )


def old_letters(text: Column) -> Column:
    """How many 5s and 6s a text has."""
    return F.length(text) - F.length(F.translate(text, "65", ""))


def spelling_v1(text: Column) -> Column:
    return F.when(old_letters(text) > 2, "traditional").otherwise("modern")


def spelling_v2(text: Column) -> Column:
    return F.when(old_letters(text) > 2, "traditional").when(old_letters(text) > 0, "mixed").otherwise("modern")


def modern_spelling(text: Column) -> Column:
    """6 as bh and 5 as hl, in years too."""
    return F.replace(F.replace(text, F.lit("6"), F.lit("bh")), F.lit("5"), F.lit("hl"))


def section(text: Column, rules: list[tuple], none: tuple[str, str, str], untitled: str | None = None) -> Column:
    """(title, section, type) of the first rule that matches the lower-case text, else `none`; a null text has none."""
    out = None
    low = F.coalesce(F.lower(text), F.lit(""))
    for pattern, title, name, kind in [*rules, ("", *none)]:
        hit = F.struct(F.lit(title or untitled).cast("string").alias("title"), F.lit(name).alias("section"), F.lit(kind).alias("type"))
        out = F.when(low.rlike(pattern), hit) if out is None else out.when(low.rlike(pattern), hit)
    return out


def repetitive(text: Column) -> Column:
    """Six words or more, and one word pair makes up over 0.3 of all, or a listed phrase stands twice."""
    n = F.size(pieces(text))
    pairs = let(pieces(text), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))
    # the commonest pair of the sorted pairs: the longest run of equals
    s = F.array_sort(pairs)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    best = F.aggregate(s, start, step, lambda a: a["best"])
    listed = F.lit(False)
    for p in lx.REPEATED_PHRASES:
        listed = listed | (F.size(found(F.lower(text), p)) >= 2)
    return F.coalesce((n >= 6) & (((n - 1 > 4) & (best > (n - 1) * 0.3)) | listed), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_header(line: Column, strict: bool = True) -> Column:
    """Whether a line is a header, footer or page number; strict keeps the rule that is a character class."""
    s = strip(line)
    out = (s == "") | ((F.length(s) <= 2) & ~s.isin(lx.SHORT_LINES))
    for p in [*lx.HEADER_LINES, *([lx.HEADER_CLASS] if strict else [])]:
        out = out | s.rlike(p)
    return out


def first_prefix(low: Column, prefixes: list[str]) -> Column:
    """The first of the prefixes that a lower-case word starts with, at least two characters shorter than the word."""
    out = None
    for p in prefixes:
        hit = low.startswith(p) & (F.length(low) > len(p) + 1)
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return out


def confidence_band(n: Column) -> Column:
    return F.when(n >= 20, "HIGH_CONFIDENCE").when(n >= 5, "SUPPORTED").otherwise("OBSERVED")
