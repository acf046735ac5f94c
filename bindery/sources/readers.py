"""Scans: JSON envelopes, CSV volumes, candidate traces; row ordinals and source tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from bindery.operators.shared import stored
from bindery.sources import schemas


def _there(read, path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON envelopes with their position; the metadata is not read."""
    raw = _there(lambda: spark.read.schema(schemas.ENVELOPE).option("multiLine", True).json(path), path)
    return raw.select(F.posexplode("records").alias("input_index", "r")).select("input_index", "r.*")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV file of volumes with doubled quotes; ISBNs stay strings, blanks become null."""
    raw = _there(lambda: spark.read.schema(schemas.VOLUME).option("header", True).option("multiLine", True).option("escape", '"').csv(path), path)
    return raw.withColumns({f.name: F.nullif(F.col(f.name), F.lit("")) for f in raw.schema if f.dataType.simpleString() == "string"})


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """The scored candidates of a JSON array of traces, one row each with its position."""
    raw = _there(lambda: spark.read.schema(schemas.TRACE).option("multiLine", True).json(path), path)
    return raw.select("rec_id", "input_index", "csv_row_number", F.col("title").alias("query_title"), F.col("author").alias("query_author"), "isbn13_input", "best_score", F.posexplode_outer("candidates").alias("pos", "c")).select("*", "c.*").drop("c")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """API items, one JSON document a line."""
    return _there(lambda: spark.read.schema(schemas.ITEM).json(path), path)


def parse_items(bodies: Column) -> Column:
    """The items of response bodies."""
    return F.from_json(bodies, f"items array<struct<{schemas.ITEM.replace(chr(10), '').replace('id string', 'id:string', 1).replace('selfLink string', 'selfLink:string').replace('volumeInfo struct', 'volumeInfo:struct').replace('saleInfo struct', 'saleInfo:struct')}>>")["items"]


def with_ordinal(df: DataFrame, name: str, *order: Column | str, by: list[str] | None = None) -> DataFrame:
    """A 1-based string ordinal in an explicit, unique order, per group where ``by`` names one; see ``running_total``."""
    return numbered(df, name, *order, by=by).withColumn(name, F.col(name).cast("string"))


def numbered(df: DataFrame, name: str, *order: Column | str, by: list[str] | None = None) -> DataFrame:
    """A 1-based row number in an explicit, unique order, global or per group, without a task that holds a group."""
    return running_total(df, name, F.lit(1).cast("bigint"), *order, by=by)


def scan_order(df: DataFrame) -> DataFrame:
    """``df``, read from files, with ``_csv_row``: its rows numbered from 1 by file and place in the file."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_scan_file"), F.monotonically_increasing_id().alias("_scan_row"))
    return numbered(placed, "_csv_row", "_scan_file", "_scan_row").drop("_scan_file", "_scan_row")


def tagged(df: DataFrame, source: str, file: str | None = None) -> DataFrame:
    """Source tags; the file's name comes from the scan unless it is given."""
    return df.withColumns({"source_name": F.lit(source), "source_file": F.lit(file) if file else F.col("_metadata.file_name")})


def running_total(df: DataFrame, name: str, value: Column, *order: Column | str, by: list[str] | None = None) -> DataFrame:
    """The running sum of a value in an explicit, unique order, global or per group of the columns ``by``.

    Rows are dealt to ranges of group and order and written once, so that the ranges are the same wherever they are
    used and a large group spreads over many.  Sums run within a range; the sums of the group's earlier ranges, one
    row for each range and group that meet, are added.
    """
    groups = [F.struct(*by).alias("__g")] if by else [F.struct(F.lit(0).alias("all")).alias("__g")]
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed = df.select("*", value.alias("__v"), *groups)
    ranged = stored(keyed.repartitionByRange(F.col("__g"), *cols).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__g", "__part").agg(F.sum("__v").alias("__n"))
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.sum("__v").over(Window.partitionBy("__g", "__part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("__sum", within)
    return summed.join(before, (F.col("__g") == F.col("__h")) & (F.col("__part") == F.col("__p"))).select(*df.columns, (F.col("__sum") + F.col("__before")).alias(name))
