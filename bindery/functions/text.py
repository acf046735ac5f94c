"""Text functions: Column in, Column out.  Blank strings are null unless a function says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separators of a title's main part, in order of priority; the first that occurs anywhere cuts.
TITLE_SEPARATORS = (":", " - ", " — ", "—", "-")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), F.lit(""))


def nonblank(c: Column | str) -> Column:
    """The value itself, or null if it is only white space."""
    return F.when(F.regexp_replace(col(c), r"(?U)\s+", "") != "", col(c))


def is_blank(c: Column | str) -> Column:
    return nonblank(c).isNull()


def _latin() -> tuple[str, str]:
    """Letters that compatibility decomposition turns into one ASCII letter and combining marks."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _latin()


def fold_latin(c: Column | str) -> Column:
    """Letters without their accents, for Latin text, within the JVM."""
    return F.translate(F.regexp_replace(col(c), "[\\u0300-\\u036f]", ""), _ACCENTED, _PLAIN)


@F.pandas_udf(StringType())
def fold_nfkd(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks, for text in any script."""
    for s in parts:
        yield s.map(lambda x: "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)), na_action="ignore")


def main_title(c: Column | str, fold=fold_latin) -> Column:
    """The part before the first separator in priority, folded, without marks, in lower case.

    Inner double spaces that marks leave behind are kept.
    """
    text = col(c)
    cut = F.lit(None).cast("string")
    for separator in reversed(TITLE_SEPARATORS):
        cut = F.when(F.instr(text, separator) > 0, F.substring_index(text, separator, 1)).otherwise(text if separator == TITLE_SEPARATORS[-1] else cut)
    plain = F.regexp_replace(fold(normalize_whitespace(cut)), r"(?U)[^0-9A-Za-z\s]", " ")
    return F.nullif(F.lower(F.trim(plain)), F.lit(""))


def match_author(c: Column | str) -> Column:
    return normalize_whitespace(F.lower(col(c)))


def match_key(title: Column | str, author: Column | str, missing: str = "") -> Column:
    """``title|author``, null where both are missing; ``missing`` stands for one that is."""
    t, a = col(title), col(author)
    return F.when(t.isNotNull() | a.isNotNull(), F.concat(F.coalesce(t, F.lit(missing)), F.lit("|"), F.coalesce(a, F.lit(missing))))


def normalize_for_comparison(c: Column | str) -> Column:
    """Marks deleted, white space collapsed, lower case; null becomes the empty string."""
    plain = F.regexp_replace(F.regexp_replace(col(c), r"(?U)[^0-9A-Za-z\s]", ""), r"(?U)\s+", " ")
    return F.coalesce(F.lower(F.trim(plain)), F.lit(""))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(col(c), r"(?U)\W+"), lambda t: t != ""))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared distinct tokens over those of the larger side; 0 if either side has none."""
    x, y = token_set(a), token_set(b)
    shared = F.size(F.array_intersect(x, y)).cast("double")
    return F.coalesce(F.when((F.size(x) > 0) & (F.size(y) > 0), shared / F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def listify(c: Column | str) -> Column:
    """Parts between commas and semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), "[,;]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def distinct_in_order(c: Column | str) -> Column:
    return F.array_distinct(col(c))


def join_list(c: Column | str, separator: str = ";") -> Column:
    """The non-empty parts, joined."""
    return F.array_join(F.filter(col(c), lambda x: x.isNotNull() & (x != "")), separator)


def first_part(c: Column | str, separator: str = ";") -> Column:
    return F.substring_index(col(c), separator, 1)


def rating(c: Column | str) -> Column:
    """The number before ``avg rating``."""
    return F.regexp_extract(col(c), r"(\S+)\s+avg rating", 1).try_cast("double")


def ratings_count(c: Column | str) -> Column:
    """The count between the last dash and ``ratings``; the singular form has none."""
    return F.replace(F.regexp_extract(col(c), r"^(?s)(?:(?!ratings).)*?—?\s*([0-9,]+)\s*ratings", 1), F.lit(","), F.lit("")).try_cast("bigint")


def absolute_url(path: Column | str, base: str) -> Column:
    """The path under a base address; null without a path."""
    return F.concat(F.lit(base), nonblank(path))


def redact(c: Column | str) -> Column:
    """Hide the value of an API key in a logged address."""
    return F.regexp_replace(col(c), r"([?&]key=)[^&]*", "$1***")
