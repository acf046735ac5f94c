"""Identity of a book."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import col


def canonical_key(title: Column | str, author: Column | str, publisher: Column | str | None = None, year: Column | str | None = None) -> Column:
    """SHA-1 of the four parts in lower case and trimmed, with bars between; a missing part is empty."""
    parts = [F.lit("") if p is None else F.coalesce(F.lower(F.regexp_replace(col(p).cast("string"), r"(?U)^\s+|\s+$", "")), F.lit("")) for p in (title, author, publisher, year)]
    return F.sha1(F.concat_ws("|", *parts))


def book_id(isbn13: Column | str, valid: Column, key: Column | str) -> Column:
    return F.when(valid, col(isbn13)).otherwise(col(key))
