"""Data-quality metrics in one aggregate, and assertions on them."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.text import nonblank

logger = logging.getLogger(__name__)

#: Thresholds of the metrics; percentages are lower bounds, duplicates upper bounds.
THRESHOLDS = {
    "porcentaje_fechas_validas": 90.0,
    "porcentaje_idiomas_validos": 95.0,
    "porcentaje_monedas_validas": 95.0,
    "porcentaje_isbn13_validos": 90.0,
    "completitud_promedio": 90.0,
    "duplicados_isbn13": 0.0,
    "duplicados_book_id": 0.0,
}
#: Columns whose nulls are counted, and which make a row complete.
COLUMNS = ("book_id", "titulo", "autor_principal", "isbn13", "fecha_publicacion", "idioma", "precio", "moneda")
FLAGS = {"porcentaje_fechas_validas": "fecha_publicacion_valida", "porcentaje_idiomas_validos": "idioma_valido", "porcentaje_monedas_validas": "moneda_valida", "porcentaje_isbn13_validos": "isbn13_valido"}


def _text(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")


def null_counts(df: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    """Per column, the rows where it is null or blank."""
    return [F.count_if(nonblank(_text(df, c)).isNull()).alias(f"nulls_{c}") for c in columns]


def percent(flag: Column) -> Column:
    """The share of true flags in percent, to two places; 0 without rows."""
    return F.coalesce(F.round(F.lit(100.0) * F.count_if(flag) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2), F.lit(0.0))


def completeness(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The mean share of filled columns in percent; white space counts as filled here."""
    full = sum(F.when(F.coalesce(_text(df, c), F.lit("")) != "", 1).otherwise(0) for c in columns)
    return F.coalesce(F.round(F.avg(full / F.lit(float(len(columns)))) * 100, 2), F.lit(0.0))


def duplicates(df: DataFrame, c: str) -> Column:
    """Filled values less distinct ones."""
    value = F.nullif(_text(df, c), F.lit(""))
    return F.count(value) - F.count_distinct(value)


def rows_per_source(df: DataFrame, fallbacks: tuple[str, ...]) -> DataFrame:
    source = F.coalesce(*(nonblank(F.col(c)) for c in fallbacks if c in df.columns), F.lit("unknown"))
    return df.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def bundle(df: DataFrame, columns: tuple[str, ...] = COLUMNS, keys: tuple[str, ...] = ("isbn13", "book_id"), flags: dict[str, str] | None = None) -> DataFrame:
    """All scalar metrics of a relation as one row, in one pass."""
    told = FLAGS if flags is None else flags
    valid = [percent(F.col(c) if c in df.columns else F.lit(False)).alias(name) for name, c in told.items()]
    return df.agg(F.count(F.lit(1)).alias("filas_totales"), *null_counts(df, columns), *valid, completeness(df, columns).alias("completitud_promedio"), *(duplicates(df, k).alias(f"duplicados_{k}") for k in keys))


def metrics(df: DataFrame, detail: DataFrame | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The metrics document: one row with maps of null counts and rows per source."""
    flat = bundle(df, columns)
    per = rows_per_source(df, ("fuente_ganadora", "source_name")) if detail is None else rows_per_source(detail, ("source_name",))
    by = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("filas_por_fuente"))
    nulls = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(f"nulls_{c}"))))
    row = flat.select("filas_totales", nulls.alias("nulos_por_campo"), *FLAGS, "completitud_promedio", "duplicados_isbn13", "duplicados_book_id")
    return row.join(F.broadcast(by))  # one row each


def safe_metrics(metrics_row: DataFrame, df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The metrics, computed now; if that fails, the least that lets a run go on: row and null counts, and zeros."""
    spark = df.sparkSession
    try:
        return spark.createDataFrame([metrics_row.first()], metrics_row.schema)
    except PySparkException as e:
        logger.warning("metrics failed, writing counts alone: %s", str(e).splitlines()[0])
    try:
        told = df.agg(F.count(F.lit(1)).alias("n"), *null_counts(df, columns)).first()
    except PySparkException:
        told = None
    nulls = {c: told[f"nulls_{c}"] for c in columns} if told else {}
    flat = (told["n"] if told else 0, nulls, *(0.0 for _ in FLAGS), 0.0, 0, 0, {})
    kinds = ["filas_totales bigint", "nulos_por_campo map<string,bigint>", *(f"{c} double" for c in FLAGS), "completitud_promedio double", "duplicados_isbn13 bigint", "duplicados_book_id bigint", "filas_por_fuente map<string,bigint>"]
    return spark.createDataFrame([flat], ", ".join(kinds))


def assertions(metrics_row: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, threshold, passed) of each threshold that has a metric."""
    chosen = {k: v for k, v in (THRESHOLDS if thresholds is None else thresholds).items() if k in metrics_row.columns}
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in chosen.items()))
    flat = metrics_row.select(F.inline(rows))
    return flat.withColumn("passed", F.when(F.startswith("metric", F.lit("duplicados")), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")))


def blocking(df: DataFrame, min_titles: float = 0.9, key: str = "book_id", title: str = "titulo") -> DataFrame:
    """One row if titles are present in the share asked for and the key is unique; the query fails otherwise."""
    told = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(nonblank(title).isNotNull()).alias("titled"), duplicates(df, key).alias("twice"))
    ok = ((F.col("n") == 0) | (F.col("titled") >= F.col("n") * min_titles)) & (F.col("twice") == 0)
    return told.select("n", "titled", "twice", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("titles are missing or keys repeat")).cast("boolean")).alias("passed"))
