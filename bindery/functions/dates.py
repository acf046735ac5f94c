"""Publication dates in many notations to ISO dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import col, let

#: Month names by number.  The first three letters of a word are looked up before the word.
MONTHS = {
    1: ("jan", "january", "ene", "enero"),
    2: ("feb", "february", "febrero"),
    3: ("mar", "march", "marzo"),
    4: ("apr", "april", "abril"),
    5: ("may", "mayo"),
    6: ("jun", "june", "junio"),
    7: ("jul", "july", "julio"),
    8: ("aug", "august", "agosto"),
    9: ("sep", "september", "septiembre", "set", "setiembre"),
    10: ("oct", "october", "octubre"),
    11: ("nov", "november", "noviembre"),
    12: ("dec", "december", "diciembre"),
}


def month_number(word: Column) -> Column:
    """The month that a word names; null if none."""
    names = F.create_map(*(F.lit(x) for number, names in MONTHS.items() for name in names for x in (name, number)))
    low = F.lower(word)
    return F.coalesce(F.try_element_at(names, F.substring(low, 1, 3)), F.try_element_at(names, low))


def _date(year: Column, month: Column, day: Column) -> Column:
    """ISO date of the parts; null if there is no such day."""
    parts = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return let(F.try_to_date(parts, "yyyy-MM-dd"), lambda d: F.when(F.year(d) > 0, F.date_format(d, "yyyy-MM-dd")))


def _result(iso: Column, partial: Column) -> Column:
    return F.struct(iso.alias("iso"), (iso.isNotNull() & partial).alias("partial"))


def _plain(s: Column) -> Column:
    """Without ordinals after digits, the Spanish ``de`` and commas."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(?i)(\d)(st|nd|rd|th)", "$1"), r"(?i)\s+de\s+", " ")
    return F.trim(F.replace(bare, F.lit(","), F.lit(" ")))


#: The shapes of dates that count.
_DASHED = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
_NUMBERS = r"^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?$"
_AMERICAN = r"^([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$"
_NAMED = r"(?:(\d{1,2})\s+)?([A-Za-z]+)\s+(\d{4})"
_TURNED = r"^(\d{4})\s+([A-Za-z]+)$"


def _part(s: Column, pattern: str, group: int, missing: str | None = None) -> Column:
    found = F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))
    return found if missing is None else F.coalesce(found, F.lit(missing))


def _by_name(s: Column, pattern: str, year: int, month: int, day: int | None, partial: Column) -> Column:
    """The date of a pattern with a month's name; null where the word names none, which lets the next one try."""
    days = F.lit("1") if day is None else _part(s, pattern, day, "1")
    return F.when(s.rlike(pattern), let(month_number(_part(s, pattern, month)), lambda m: F.when(m.isNotNull(), _result(_date(_part(s, pattern, year), m, days), partial))))


def parse_date(c: Column | str, compat: bool = False) -> Column:
    """(iso, partial): an ISO date and whether a part of it was filled in; (null, false) if there is none.

    With ``compat``, ``Month D, YYYY`` is not understood.
    """

    def told(s: Column) -> Column:
        full = F.when(s.rlike(_DASHED), let(_date(_part(s, _DASHED, 1), _part(s, _DASHED, 2), _part(s, _DASHED, 3)), lambda d: F.when(d.isNotNull(), _result(d, F.lit(False)))))
        return F.coalesce(full, let(_plain(s), spelt))

    def spelt(s: Column) -> Column:
        numbers = F.when(s.rlike(_NUMBERS), _result(_date(_part(s, _NUMBERS, 1), _part(s, _NUMBERS, 2, "1"), _part(s, _NUMBERS, 3, "1")), F.lit(True)))
        american = [] if compat else [_by_name(s, _AMERICAN, 3, 1, 2, F.lit(False))]
        return F.coalesce(numbers, *american, _by_name(s, _NAMED, 3, 2, 1, _part(s, _NAMED, 1).isNull()), _by_name(s, _TURNED, 1, 2, None, F.lit(True)))

    none = F.struct(F.lit(None).cast("string").alias("iso"), F.lit(False).alias("partial"))
    return F.coalesce(let(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""), told), none)


def year_or(c: Column | str, missing: int = -1) -> Column:
    """The leading four-digit year."""
    return F.coalesce(F.regexp_extract(col(c), r"^(\d{4})", 1).try_cast("int"), F.lit(missing))


def published(c: Column | str) -> Column:
    """The date that follows ``Published`` in a text, by three patterns in turn."""
    # The three patterns.
    patterns = (r"Published\s+([A-Za-z]+\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4})", r"Published\s+([A-Za-z]+\s+\d{4})", r"Published\s+(\d{4})")
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(col(c), p, 1)), F.lit("")) for p in patterns))
