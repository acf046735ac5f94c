"""Scoring of candidates and choice of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import dates, text
from bindery.functions.similarity import match_score


def scored(pairs: DataFrame, title: str, author: str, isbn: str, found_title: str, found_authors: str, found_isbn: str) -> DataFrame:
    return pairs.withColumn("score", match_score(*(F.col(c) for c in (title, author, isbn, found_title, found_authors, found_isbn))))


def best_candidate(candidates: DataFrame, key: str, pos: str = "pos", isbn: str = "isbn13", date: str = "publishedDate") -> DataFrame:
    """Per key the candidate of highest score; of equals one with an ISBN, then the newer year, then the earlier."""
    rank = F.struct(F.col("score"), text.nonblank(isbn).isNotNull().cast("int"), dates.year_or(date), -F.col(pos))
    row = F.struct(*candidates.columns)
    return candidates.groupBy(key).agg(F.max_by(row, rank).alias("__row")).select("__row.*")


def best_by_fold(candidates: Column, listed_isbn: str = "listed_isbn13") -> Column:
    """The candidate that an in-order walk ends with.

    A higher score wins; at an equal score, one with an ISBN against one that lists none, else the newer year.
    The walk depends on the order, unlike a sort: a later newer one without ISBN beats an earlier one with it.
    """
    year = lambda c: dates.year_or(c["publishedDate"])
    better = lambda b, c: b.isNull() | (c["score"] > b["score"]) | ((c["score"] == b["score"]) & ((text.nonblank(c["isbn13"]).isNotNull() & text.nonblank(b[listed_isbn]).isNull()) | (year(c) > year(b))))
    return F.reduce(candidates, F.get(candidates, F.lit(-1)), lambda b, c: F.when(better(b, c), c).otherwise(b))


def best_by_walk(candidates: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Per key the candidate that ``best_by_fold`` ends with, in the order of ``pos``; a key's candidates are few.

    Without a column ``listed_isbn13``, the best's ISBN is tested like any other's.
    """
    listed = candidates if "listed_isbn13" in candidates.columns else candidates.withColumn("listed_isbn13", F.col("isbn13"))
    held = listed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, F.struct(*listed.columns).alias("row")))).alias("c"))
    best = held.select(best_by_fold(F.transform("c", lambda x: x["row"])).alias("row"))
    return best.select(*(F.col("row")[c].alias(c) for c in candidates.columns))


def max_score(candidates: DataFrame, key: str) -> DataFrame:
    return candidates.groupBy(key).agg(F.max("score").alias("best_score"))


def top_one_lookup(records: DataFrame, candidates: DataFrame, key: str, **columns: str) -> DataFrame:
    """Each record with its best candidate, nulls without one."""
    best = best_candidate(candidates, key, **columns)
    return records.join(best.select(F.col(key).alias("__key"), *(F.col(c).alias(f"best_{c}") for c in best.columns if c != key)), F.col(key) == F.col("__key"), "left").drop("__key")
