"""ISBN functions: cleaning, check digits, conversion and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import col, let


def clean(c: Column | str) -> Column:
    """Digits and X only, upper case; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(col(c), "[^0-9Xx]", "")), F.lit(""))


def _weighted(digits: Column, n: int, weight) -> Column:
    """Sum of the first n digits times their weights."""
    return sum(F.substring(digits, i, 1).cast("int") * weight(i) for i in range(1, n + 1))


def _check10(s: Column) -> Column:
    rest = (11 - _weighted(s, 9, lambda i: 11 - i) % 11) % 11
    return F.replace(rest.cast("string"), F.lit("10"), F.lit("X"))


def _check13(s: Column) -> Column:
    return ((10 - _weighted(s, 12, lambda i: 1 if i % 2 else 3) % 10) % 10).cast("string")


def _valid10(s: Column) -> Column:
    return F.coalesce(F.when(s.rlike("^[0-9]{9}[0-9X]$"), _check10(s) == F.substring(s, 10, 1)), F.lit(False))


def _valid13(s: Column) -> Column:
    return F.coalesce(F.when(s.rlike("^[0-9]{13}$"), _check13(s) == F.substring(s, 13, 1)), F.lit(False))


def _to13(s: Column) -> Column:
    return let(F.concat(F.lit("978"), F.substring(s, 1, 9)), lambda core: F.concat(core, _check13(core)))


def check10(digits9: Column | str) -> Column:
    """The check character of nine digits."""
    return let(col(digits9), _check10)


def check13(digits12: Column | str) -> Column:
    """The check digit of twelve digits."""
    return let(col(digits12), _check13)


def is_valid10(c: Column | str) -> Column:
    """Whether ten characters of a cleaned ISBN check out; false for null."""
    return let(col(c), _valid10)


def is_valid13(c: Column | str) -> Column:
    """Whether thirteen digits check out, under any prefix; false for null."""
    return let(col(c), _valid13)


def to13(isbn10: Column | str) -> Column:
    """The ISBN-13 of a valid ISBN-10; null otherwise."""
    return let(col(isbn10), lambda s: F.when(_valid10(s), _to13(s)))


def normalize(c: Column | str) -> Column:
    """(isbn10, isbn13): both for a valid ISBN-10, the latter for a valid ISBN-13, neither otherwise."""
    none = F.lit(None).cast("string")
    both = lambda ten, thirteen: F.struct(ten.alias("isbn10"), thirteen.alias("isbn13"))
    return let(clean(c), lambda s: F.when(_valid10(s), both(s, _to13(s))).when(_valid13(s), both(none, s)).otherwise(both(none, none)))


def extract(c: Column | str) -> Column:
    """All valid ISBNs in a text and the ISBN-13 of each ISBN-10, distinct and sorted.

    Digits, hyphens and spaces run together, so numbers side by side are lost.
    """
    text = F.coalesce(col(c), F.lit(""))
    # Where a text may name ISBNs.
    thirteen = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(97[89][\d\-\s]{9,}\d)\b"), 1), clean), _valid13)
    ten = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d[\d\-\s]{8,}[\dxX])\b"), 1), clean), _valid10)
    both = let(ten, lambda found: F.concat(found, F.transform(found, _to13)))
    return F.array_sort(F.array_distinct(F.concat(thirteen, both)))


def first13(candidates: Column | str) -> Column:
    """The first of a list that converts to an ISBN-13."""
    return F.get(F.filter(F.transform(col(candidates), lambda x: normalize(x)["isbn13"]), lambda x: x.isNotNull()), F.lit(0))


def from_links(*links: Column | str) -> Column:
    """The first ISBN-13 that an address holds, unchecked."""
    return F.coalesce(*(F.nullif(F.regexp_extract(col(x), "(97[89][0-9]{10})", 1), F.lit("")) for x in links))
