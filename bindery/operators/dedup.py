"""Selection of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.text import nonblank


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; nulls are one key.  ``order`` should end in a unique column.

    The choice is an aggregate whose minima are combined before the shuffle, so a key that holds a large part of
    the rows does not meet in one task.
    """
    keys = [k.alias(f"__k{i}") for i, k in enumerate(key)]
    names = [f"__k{i}" for i in range(len(key))]
    row = F.struct(*df.columns)
    kept = df.select(*keys, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("__o"), row.alias("__row")).groupBy(*names).agg(F.min_by("__row", "__o").alias("__row"))
    return kept.select("__row.*")


def completeness(columns: list[str]) -> Column:
    """How many of the columns hold something."""
    return sum(F.when(nonblank(F.col(c).cast("string")).isNotNull(), 1).otherwise(0) for c in columns)


def keep_best(df: DataFrame, key: str, scored: list[str], ordinal: str) -> DataFrame:
    """Per key the row with most filled columns, the earliest of equals."""
    return keep_first(df, [F.col(key)], [-completeness([c for c in scored if c in df.columns]), F.col(ordinal)])


def duplicate_groups(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The largest groups of equal keys, a null key among them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(limit)


def ranked(df: DataFrame, name: str, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
