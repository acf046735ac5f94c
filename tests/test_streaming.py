from pyspark.sql import functions as F

from bindery.plans import source_queries
from bindery.streaming import streams
from tests.conftest import DATA


def test_rows_per_source(spark):
    """A batch after the last event closes all windows before it; late rows beyond the delay are not counted."""
    told = streams.rows_per_source(source_queries._events(spark, DATA), "ts", "1 minute", "1 hour", "event_type")
    found = source_queries._run(told.select(F.col("window.start").alias("start"), "source", "n"), spark, "append")
    events = spark.read.parquet(f"{DATA}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start"), F.col("event_type").alias("source")).count()
    whole = {(r["start"], r["source"]): r["count"] for r in events.collect()}
    closed = {(r["start"], r["source"]): r["n"] for r in found.collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_normalized_stream(spark):
    stream = source_queries._events(spark, DATA).select(F.lit("EN-us").alias("idioma"), F.lit("0306406152").alias("isbn13"), F.lit("$").alias("moneda"))
    row = source_queries._run(streams.normalized(stream).select("idioma", "isbn13_norm", "moneda", "fecha_publicacion_valida"), spark, "append").first()
    assert tuple(row) == ("en-US", "9780306406157", "USD", False)
