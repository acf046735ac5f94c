"""Record linkage between a left (primary) and a right (secondary) source.

The left side carries ``gr_index`` and the right side ``_csv_row`` as ordinals; both have ``titulo``,
``autor_principal``, ``isbn13``, ``_match_title`` and ``_match_key``.  Right-hand lookups are reduced to one row
per key by aggregates, and joined by equality, so Spark may broadcast, sort or split them by their sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import text
from bindery.operators.dedup import keep_first
from bindery.operators.skew import apart


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{c}{suffix}") for c in df.columns))


def isbn_join(left: DataFrame, right: DataFrame, unique: bool = True) -> DataFrame:
    """Left join on isbn13 of the left rows that have one; ``unique`` first keeps one right row per isbn13."""
    own = left.where(F.col("isbn13").isNotNull())
    other = keep_first(right.where(F.col("isbn13").isNotNull()), [F.col("isbn13")], [F.col("_csv_row")]) if unique else right
    return suffixed(own, "_gr").join(suffixed(other, "_gb"), F.col("isbn13_gr") == F.col("isbn13_gb"), "left")


def key_join(left: DataFrame, right: DataFrame, compat: bool = False) -> DataFrame:
    """Left join on the match key of the left rows without isbn13; in ``compat`` null keys match each other."""
    own = suffixed(left.where(F.col("isbn13").isNull()), "_gr")
    other = suffixed(right, "_gb")
    same = F.col("_match_key_gr").eqNullSafe(F.col("_match_key_gb")) if compat else F.col("_match_key_gr") == F.col("_match_key_gb")
    return own.join(other, same, "left")


def first_match(left: DataFrame, right: DataFrame, copied: list[str]) -> DataFrame:
    """Left rows without isbn13 take it, and ``copied``, from the earliest right row of their match key.

    The row is picked before its ISBN is looked at; without one, nothing is taken.
    """
    pick = keep_first(right.where(F.col("_match_key").isNotNull()), [F.col("_match_key")], [F.col("_csv_row")]).where(text.nonblank("isbn13").isNotNull())
    found = pick.select(apart(F.col("_match_key"), "string").alias("__key"), F.col("isbn13").alias("__isbn"), F.col("_csv_row").alias("__row"), *(F.col(c).alias(f"__{c}") for c in copied))
    take = text.nonblank("isbn13").isNull() & F.col("__isbn").isNotNull()
    joined = left.join(found, F.col("_match_key") == F.col("__key"), "left")
    return _taken(joined, left.columns, take, copied, "key")


def unique_title_match(left: DataFrame, right: DataFrame, copied: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, events): rows still without isbn13 take it from the only right row of their title.

    Titles that several right rows have assign nothing and give an event with those rows instead.
    """
    titles = right.where(F.col("_match_title").isNotNull()).groupBy("_match_title").agg(F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(F.col("isbn13").alias("__isbn"), F.col("_csv_row").alias("__row"), *(F.col(c).alias(f"__{c}") for c in copied)), "_csv_row").alias("__one"))
    titles = titles.select(apart(F.col("_match_title"), "string").alias("__title"), "__n", "__one.*")
    joined = left.join(titles, F.col("_match_title") == F.col("__title"), "left")
    open_ = text.nonblank("isbn13").isNull() & F.col("__n").isNotNull()
    rows = _taken(joined, left.columns, open_ & (F.col("__n") == 1) & text.nonblank("__isbn").isNotNull(), copied, "title")
    unclear = joined.where(open_ & (F.col("__n") > 1)).select(F.col("_match_title").alias("match_title"), "gr_index")
    listed = right.join(unclear.select(F.col("match_title").alias("_match_title")).distinct(), "_match_title", "left_semi").groupBy(F.col("_match_title").alias("match_title")).agg(F.array_sort(F.collect_list("_csv_row")).alias("gb_candidate_rows"))
    events = unclear.join(listed, "match_title").select(F.lit("ambiguous_gb_candidates").alias("event"), "match_title", "gr_index", "gb_candidate_rows")
    return rows, events


def _taken(joined: DataFrame, columns: list[str], take: Column, copied: list[str], by: str) -> DataFrame:
    """The left columns, and what was taken in new or already present columns."""
    was = lambda name, kind: F.col(name) if name in columns else F.lit(None).cast(kind)
    told = {"isbn13": F.when(take, F.col("__isbn")).otherwise(F.col("isbn13")), "isbn13_source": F.when(take, F.lit("google_books")).otherwise(was("isbn13_source", "string")), "isbn13_source_row": F.when(take, F.col("__row")).otherwise(was("isbn13_source_row", "bigint")), "match_rule": F.when(take, F.lit(by)).otherwise(was("match_rule", "string"))}
    told |= {f"{c}_gb": F.when(take, F.col(f"__{c}")).otherwise(F.col(f"{c}_gb") if f"{c}_gb" in columns else F.lit(None)) for c in copied}
    return joined.select(*(F.col(c) for c in columns if c not in told), *(v.alias(k) for k, v in told.items()))


def unmatched(right: DataFrame, merged: list[DataFrame]) -> DataFrame:
    """Right rows that no merged row holds, by their ordinal."""
    held = reduce(DataFrame.unionAll, [m.select(F.col("_csv_row_gb").alias("_csv_row")) for m in merged]).where(F.col("_csv_row").isNotNull())
    return right.join(held, "_csv_row", "left_anti")


def merge(left: DataFrame, right: DataFrame, compat: bool = False) -> DataFrame:
    """The prioritised full outer join as three disjoint branches, told apart by ``_source_type``."""
    by_isbn = isbn_join(left, right, unique=not compat).withColumn("_source_type", F.lit("merged_by_isbn"))
    by_key = key_join(left, right, compat).withColumn("_source_type", F.lit("merged_by_key"))
    rest = suffixed(unmatched(right, [by_isbn, by_key]), "_gb").withColumn("_source_type", F.lit("gb_only"))
    return by_isbn.unionByName(by_key, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
