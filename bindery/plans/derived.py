"""Inputs that queries derive from the test tables, and the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import isbn
from bindery.plans.pipeline import normalize_left, normalize_right


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def core(key: Column) -> Column:
    return F.lpad(key.cast("string"), 9, "0")


def isbn13(key: Column, prefix: str = "978") -> Column:
    twelve = F.concat(F.lit(prefix), core(key))
    return F.concat(twelve, isbn.check13(twelve))


def isbn10(key: Column) -> Column:
    return F.concat(core(key), isbn.check10(core(key)))


def sql_core(key: str) -> str:
    return f"lpad(CAST({key} AS VARCHAR), 9, '0')"


def sql_check13(twelve: str) -> str:
    return f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({twelve}, i, 1) AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))) % 10) % 10 AS INTEGER)"


def sql_check10(nine: str) -> str:
    return f"CAST((11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr({nine}, i, 1) AS INTEGER) * (11 - i))) % 11) % 11 AS INTEGER)"


def sql_isbn13(key: str, prefix: str = "978") -> str:
    twelve = f"('{prefix}' || {sql_core(key)})"
    return f"({twelve} || CAST({sql_check13(twelve)} AS VARCHAR))"


def sql_isbn10(key: str) -> str:
    c = sql_check10(sql_core(key))
    return f"({sql_core(key)} || CASE WHEN {c} = 10 THEN 'X' ELSE CAST({c} AS VARCHAR) END)"


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping sources of books made of ``part``, before normalisation."""
    p = table(spark, sf_dir, "part")
    key, gone = F.col("p_partkey"), F.col("p_partkey") % 100 == 7
    title = F.concat_ws(" ", "p_name", "p_brand")
    left = p.where(key % 3 != 2).select(
        key.alias("input_index"),
        F.when(~gone, F.concat(title, F.lit(": a story"))).alias("title"),
        F.when(~gone, F.col("p_type")).alias("author"),
        F.col("p_retailprice").alias("price_amount"),
        F.when(key % 4 == 0, "usd").alias("price_currency"),
        F.when(key % 2 == 0, F.concat(F.lit("January "), (key % 28 + 1).cast("string"), F.lit(", 2020"))).alias("pub_date"),
        F.lit(None).cast("string").alias("isbn10"),
        F.when(key % 9 == 0, isbn13(key)).alias("isbn13"),
    )
    right = p.where(key % 3 != 0).select(
        key.alias("_csv_row"),
        F.when(~gone, F.upper(title)).alias("title"),
        F.when(~gone, F.concat(F.col("p_type"), F.lit("; Other"))).alias("authors"),
        F.concat(F.lit("House "), (key % 5).cast("string")).alias("publisher"),
        F.lit("2019").alias("pub_date"),
        F.lit("EN-us").alias("language"),
        F.lit("Fiction;Short, Fiction").alias("categories"),
        F.when(key % 5 != 0, F.when(key % 3 == 1, isbn13(key - 1)).otherwise(isbn13(key))).alias("isbn13"),
        F.lit(None).cast("string").alias("isbn10"),
        F.lit(9.5).alias("price_amount"),
        F.lit("€").alias("price_currency"),
    )
    return left, right


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left, right = sources(spark, sf_dir)
    return normalize_left(left), normalize_right(right)


#: The same two sources with their match keys, as common table expressions l and r.
LINKED = f"""
l AS (SELECT p_partkey AS gr_index, mt, ma, mt || '|' || ma AS mk, isbn13 FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 100 <> 7 THEN lower(p_name || ' ' || replace(p_brand, '#', ' ')) END AS mt,
    CASE WHEN p_partkey % 100 <> 7 THEN lower(p_type) END AS ma,
    CASE WHEN p_partkey % 9 = 0 THEN {sql_isbn13("p_partkey")} END AS isbn13
  FROM part WHERE p_partkey % 3 <> 2)),
r AS (SELECT p_partkey AS csv_row, mt, ma, mt || '|' || ma AS mk, isbn13 FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 100 <> 7 THEN lower(p_name || ' ' || replace(p_brand, '#', ' ')) END AS mt,
    CASE WHEN p_partkey % 100 <> 7 THEN lower(p_type) END AS ma,
    CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 3 = 1 THEN {sql_isbn13("(p_partkey - 1)")} ELSE {sql_isbn13("p_partkey")} END END AS isbn13
  FROM part WHERE p_partkey % 3 <> 0)),
pick AS (SELECT mk, arg_min(isbn13, csv_row) FILTER (csv_row IS NOT NULL) AS any_isbn, min(csv_row) AS row FROM r WHERE mk IS NOT NULL GROUP BY mk),
first_ AS (SELECT pick.mk, r.isbn13, pick.row FROM pick JOIN r ON r.csv_row = pick.row WHERE r.isbn13 IS NOT NULL),
a1 AS (SELECT l.*, CASE WHEN l.isbn13 IS NULL THEN f.isbn13 END AS got, CASE WHEN l.isbn13 IS NULL THEN f.row END AS got_row FROM l LEFT JOIN first_ f ON l.mk = f.mk),
titles AS (SELECT mt, count(*) AS n, min(csv_row) AS row, list(csv_row ORDER BY csv_row) AS all_rows FROM r WHERE mt IS NOT NULL GROUP BY mt),
a2 AS (SELECT a1.gr_index, a1.mt, a1.mk, a1.isbn13 AS own, coalesce(a1.isbn13, a1.got) AS i1, a1.got_row, t.n, t.all_rows, r.isbn13 AS t_isbn, t.row AS t_row
  FROM a1 LEFT JOIN titles t ON a1.mt = t.mt LEFT JOIN r ON r.csv_row = t.row),
assigned AS (SELECT gr_index, mt, mk, CASE WHEN i1 IS NULL AND n = 1 THEN t_isbn ELSE i1 END AS isbn13,
  CASE WHEN i1 IS NULL AND n = 1 AND t_isbn IS NOT NULL THEN t_row ELSE got_row END AS source_row FROM a2),
r1 AS (SELECT isbn13, min(csv_row) AS csv_row FROM r WHERE isbn13 IS NOT NULL GROUP BY isbn13),
by_isbn AS (SELECT s.gr_index, s.mt, s.isbn13, r1.csv_row, 'merged_by_isbn' AS source_type FROM assigned s LEFT JOIN r1 ON s.isbn13 = r1.isbn13 WHERE s.isbn13 IS NOT NULL),
by_key AS (SELECT s.gr_index, s.mt, s.isbn13, r.csv_row, 'merged_by_key' AS source_type FROM assigned s LEFT JOIN r ON s.mk = r.mk WHERE s.isbn13 IS NULL),
merged AS (SELECT * FROM by_isbn UNION ALL SELECT * FROM by_key
  UNION ALL SELECT NULL, NULL, NULL, csv_row, 'gb_only' FROM r WHERE csv_row NOT IN (SELECT csv_row FROM by_isbn WHERE csv_row IS NOT NULL UNION ALL SELECT csv_row FROM by_key WHERE csv_row IS NOT NULL))
"""
