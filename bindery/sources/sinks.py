"""Sinks: envelopes, CSV, Parquet, candidate traces, metrics, and logs that are only appended to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from bindery.functions.text import redact
from bindery.sources import schemas


def envelope(records: DataFrame, order: str | None = None, **metadata: str) -> DataFrame:
    """One row with a JSON document of metadata and all records.  For result pages, which are small."""
    columns = [c for c in records.columns if c != order]
    rows = F.collect_list(F.struct(F.col(order).alias("__o") if order else F.lit(0).alias("__o"), F.struct(*columns).alias("r")))
    whole = records.agg(F.transform(F.array_sort(rows), lambda x: x["r"]).alias("records"))
    told = F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()), F.size("records").alias("record_count"))
    return whole.select(F.to_json(F.struct(told.alias("metadata"), "records"), {"ignoreNullFields": "false"}).alias("value"))


def write_envelope(records: DataFrame, path: str, order: str | None = None, **metadata: str) -> None:
    envelope(records, order, **metadata).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """The fixed columns of volumes, nulls blank, quotes doubled."""
    df.select(*(c.split()[0] for c in schemas.VOLUME.split(", "))).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Replace the table; the committer makes a failed write leave no part of it.

    Columns of types that Parquet cannot hold are converted first (``sanitized``); if the write still fails on a
    type, all columns are written as text.
    """
    fit = sanitized(df)
    try:
        fit.write.mode("overwrite").parquet(path)
    except AnalysisException as e:
        if "UNSUPPORTED_DATA_TYPE" not in str(e):
            raise
        as_text(fit).write.mode("overwrite").parquet(path)


#: What Parquet holds as it is.
_HELD = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "binary")


def _plain(kind: str) -> bool:
    """Whether Parquet holds a type: those above, decimals, and lists and structs of them."""
    return kind in _HELD or kind.startswith(("decimal", "array<", "struct<", "map<")) and not any(x in kind for x in ("void", "interval", "variant"))


def sanitized(df: DataFrame) -> DataFrame:
    """Values as a table holds them: NaN is null, untyped columns and intervals are text, maps are JSON documents."""

    def fit(c: str, kind: str) -> Column:
        if kind in ("float", "double"):
            return F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`"))
        if kind.startswith("map<") or kind == "variant":
            return F.to_json(f"`{c}`")
        return F.col(f"`{c}`") if _plain(kind) else F.col(f"`{c}`").cast("string")

    return df.select(*(fit(c, kind).alias(c) for c, kind in df.dtypes))


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: bytes as UTF-8, lists, structs and maps as JSON documents, NaN as null."""

    def told(c: str, kind: str) -> Column:
        if kind == "binary":
            return F.decode(F.col(f"`{c}`"), "UTF-8")
        return F.to_json(f"`{c}`") if kind.startswith(("array<", "struct<", "map<")) else F.col(f"`{c}`").cast("string")

    return sanitized(df).select(*(told(c, kind).alias(c) for c, kind in sanitized(df).dtypes))


def whole_number(c: Column | str) -> Column:
    """A number or a text as a nullable bigint; whatever is none, or has a fraction, is null."""
    value = F.col(c) if isinstance(c, str) else c
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), F.coalesce(F.trim(value.cast("string")).try_cast("bigint"), number.try_cast("bigint")))


def trace(scored: DataFrame) -> DataFrame:
    """One row for each record: its candidates in order and the best score."""
    fields = [c.split()[0] for c in schemas.CANDIDATE.split(", ")]
    listed = F.array_sort(F.collect_list(F.when(F.col("gb_id").isNotNull(), F.struct("pos", *fields))))
    return scored.groupBy("rec_id", "input_index").agg(listed.alias("c"), F.max("score").alias("best_score")).select("rec_id", "input_index", F.transform("c", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("candidates"), "best_score")


def write_trace(traced: DataFrame, records: DataFrame, path: str) -> None:
    """The trace with what was asked for, one JSON document a line."""
    asked = records.select("rec_id", F.col("title"), F.col("author"), F.col("isbn13").alias("isbn13_input"))
    traced.join(asked, "rec_id", "left").write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Audit events, one JSON document a line."""
    events.write.mode("append").json(path)


def request_log(requests: DataFrame) -> DataFrame:
    """The columns of the request log; the key in an address is hidden before it is stored."""
    names = [c.split()[0] for c in schemas.REQUEST_LOG.split(", ")]
    return requests.withColumn("url_or_file", redact("url_or_file")).select(*(F.col(n) if n in requests.columns else F.lit(None).cast("string").alias(n) for n in names))


def append_requests(requests: DataFrame, path: str) -> None:
    request_log(requests).write.mode("append").option("header", True).csv(path)


def metrics_json(metrics: DataFrame) -> str:
    """The one row of metrics as indented JSON."""
    import json

    return json.dumps(json.loads(metrics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]), ensure_ascii=False, indent=2)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.sparkSession.createDataFrame([(metrics_json(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(path)
