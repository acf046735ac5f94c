"""The match score of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import normalize_for_comparison, token_overlap

#: Points for an equal ISBN, for the title's edit ratio and token overlap, and for the author's.
ISBN_POINTS, RATIO_POINTS, TITLE_POINTS, AUTHOR_POINTS = 100.0, 40.0, 20.0, 40.0


def title_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def match_score(title: Column, author: Column, isbn: Column, found_title: Column, found_authors: Column, found_isbn: Column) -> Column:
    """Points of a candidate: equal ISBN, similar title if both have one, shared author tokens."""
    t, ft = normalize_for_comparison(title), normalize_for_comparison(found_title)
    same = F.when((isbn != "") & (found_isbn != "") & (normalize_for_comparison(isbn) == normalize_for_comparison(found_isbn)), ISBN_POINTS).otherwise(0.0)
    titled = F.when((t != "") & (ft != ""), title_ratio(t, ft) * RATIO_POINTS + token_overlap(t, ft) * TITLE_POINTS).otherwise(0.0)
    return same + titled + token_overlap(normalize_for_comparison(author), normalize_for_comparison(found_authors)) * AUTHOR_POINTS
