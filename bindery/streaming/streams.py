"""The same functions on streams: normalisation, first-seen deduplication, lookups in a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import isbn
from bindery.operators.survivorship import semantic


def normalized(stream: DataFrame, isbn_col: str = "isbn13") -> DataFrame:
    """Semantic values and ISBNs of a stream of records; stateless."""
    return semantic(stream).withColumn("isbn13_norm", isbn.normalize(isbn_col)["isbn13"])


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark, so the state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def looked_up(stream: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """A left join of a stream with a static table."""
    return stream.join(table, on, "left")


def rows_per_source(stream: DataFrame, time: str, delay: str, window: str, source: str = "source_name") -> DataFrame:
    """Rows of each source in tumbling windows; late rows beyond the delay are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
