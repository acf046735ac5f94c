"""Joins that Spark can split where a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(c: Column, kind: str) -> Column:
    """The same value by an expression that no earlier shuffle is known to be dealt by.

    A side that was aggregated by its join key is not shuffled again, and then Spark cannot split the other
    side's hot partitions.  Joined by this instead, the small side is shuffled once more and it can.
    """
    return F.concat(c, F.lit("")) if kind == "string" else c.bitwiseXOR(F.lit(0).cast(kind))


def join_aggregated(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, an aggregate by ``on``; the last key must be a string or an integer."""
    kinds = dict(small.dtypes)
    names = {c: f"__{c}" for c in on}
    moved = small.select(*(apart(F.col(c), kinds[c]).alias(names[c]) if c == on[-1] else F.col(c).alias(names[c]) for c in on), *(c for c in small.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(names[c]))
    return rows.join(moved, same, how).drop(*names.values())
