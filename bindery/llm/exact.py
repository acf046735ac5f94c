"""Exact deduplication by a stateful stream.

A stream of digests runs through keyed state on disk (RocksDB) that never expires: per digest the stable
identifier (smallest id), the content locator of its row (file and position) and the number of rows so far.
Rows of a digest are combined before the shuffle, so a hot group of copies is one state update per task.
Digests that were hit more than once are then checked on the full bytes, fetched by locator: rows whose bytes
differ from the stable row's form groups of their own.

With a folder for it, the state outlives the call: the next call's rows meet the digests of all earlier ones.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import UNMARKED, delete, free_shuffles, keyed, on_files, rows_at, shared_dir, written

#: Runs that one space would not equal; the others need no replacement.
_UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def _stream(spark: SparkSession, source: str, folder: str, schema, max_bytes_per_trigger: int | None, max_files_per_trigger: int | None) -> DataFrame:
    """(digest, n, rep): the state after all digests of the folders ``source``; each update is written once per batch."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each of many small stores holds 4 MB
    reader = own.readStream.schema(schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")
    state = reader.parquet(source).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"))

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").options(**UNMARKED).parquet(f"{folder}/updates/batch={k}")

    state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    updates = spark.read.schema(state.schema).parquet(f"{folder}/updates")
    return updates.groupBy("digest").agg(F.max("n").alias("n"), F.min("rep").alias("rep"))


def _earlier(spark: SparkSession, hits: DataFrame, files: str, text_col: str) -> DataFrame:
    """(digest, rep_text) of stable rows of earlier calls, read at their locators."""
    wanted = hits.select("digest", "rep_file", "rep_row").distinct()
    known = spark.read.schema("_file long, path string").parquet(f"{files}/*").distinct()
    paths = [unquote(r["path"]) for r in known.join(wanted.select(F.col("rep_file").alias("_file")).distinct(), "_file", "left_semi").select("path").collect()]
    if not paths:
        return hits.select("digest", F.lit("").alias("rep_text")).limit(0)
    rows = spark.read.parquet(*paths)
    place = rows.metadataColumn("_metadata")
    rows = rows.select(F.xxhash64(place["file_path"]).alias("rep_file"), place["row_index"].alias("rep_row"), normalised(F.col(text_col)).alias("rep_text"))
    return rows.join(wanted, ["rep_file", "rep_row"]).select("digest", "rep_text")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, max_bytes_per_trigger: int | None = 64 << 30, max_files_per_trigger: int | None = None, state_dir: str | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, _file, _row) of every row of ``docs``.

    Texts are equal when identical after each run of white space became one space; null counts as empty.  Of
    equal texts, the row with the smallest id stays; null ids come last, and of repeated ids exactly one row
    stays, the first by locator.  An empty table gives an empty result; other columns are ignored.
    ``digest_bits`` below 256 makes digests collide, for tests of the check on full bytes.

    ``state_dir``, a folder that driver and executors share, keeps the state: rows of this call are then also copies
    of rows of earlier calls with that folder, whose files must still be there, and group sizes count those too.  A
    later row of smaller id is kept although the earlier one was.  Of texts whose digests collide without being
    equal to the stable row's, copies are found within a call.
    """
    spark = docs.sparkSession
    folder, call = shared_dir(spark, "exact"), f"call-{uuid.uuid4().hex}"
    top = (state_dir or folder).rstrip("/")
    docs = on_files(docs if docs.columns == [id_col, text_col] else docs.select(id_col, text_col), f"{top}/rows/{call}")
    source = keyed(docs, [id_col, text_col], folder).select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"), "_file", "_row")
    digests = written(source.select("id", "_file", "_row", F.sha2("text", 256).alias("sha")).withColumn("digest", F.substring("sha", 1, digest_bits // 4)), top, f"digests/{call}")
    empty = digests.isEmpty()
    if state_dir and not empty:
        path = docs.metadataColumn("_metadata")["file_path"]
        written(docs.select(F.xxhash64(path).alias("_file"), path.alias("path")).distinct(), top, f"files/{call}")
    state = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")).alias("rep")) if empty else _stream(spark, f"{top}/digests/*", top, digests.schema, max_bytes_per_trigger, max_files_per_trigger)
    groups = written(state, folder, "groups")
    rows = written(digests.join(groups, "digest"), folder, "grouped")
    if not empty and not state_dir:
        delete(spark, f"{folder}/state")
        delete(spark, f"{folder}/updates")
    free_shuffles(spark)

    # Full bytes of the rows that hit a digest again, fetched by locator and held against the stable row's.
    hits = rows.where("n > 1").select("digest", "_file", "_row", F.col("rep._file").alias("rep_file"), F.col("rep._row").alias("rep_row"))
    bodies = written(source.join(hits, ["_file", "_row"]), folder, "hits")
    is_rep = (F.col("_file") == F.col("rep_file")) & (F.col("_row") == F.col("rep_row"))
    reps = bodies.where(is_rep).select("digest", F.col("text").alias("rep_text"))
    if state_dir and not empty:
        here = bodies.where(is_rep).select("digest")
        reps = reps.unionAll(written(_earlier(spark, hits.join(here, "digest", "left_anti"), f"{top}/files", text_col), folder, "earlier"))
    other = bodies.where(~is_rep).join(reps, "digest").where(F.col("text") != F.col("rep_text")).select("digest", "id", "text", "_file", "_row")
    other = written(other, folder, "other")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")
    apart = other.join(other.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n2"), F.min(place).alias("rep2")), ["digest", "text"]).select("_file", "_row", "n2", "rep2")
    less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    whole = rows.join(F.broadcast(less) if other.isEmpty() else less, "digest", "left").join(F.broadcast(apart) if other.isEmpty() else apart, ["_file", "_row"], "left")
    rep = F.coalesce("rep2", "rep")
    return whole.select(
        "id",
        rep["id"].alias("keep_id"),
        F.when(F.col("rep2").isNotNull(), F.col("n2")).otherwise(F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"),
        ((F.col("_file") == rep["_file"]) & (F.col("_row") == rep["_row"])).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "_file",
        "_row",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Null texts count as empty, of repeated ids one row stays, and an empty table stays empty, as by ``exact_groups``;
    texts of any length are read whole.
    """
    docs = on_files(docs, shared_dir(docs.sparkSession, "exact") if state_dir is None else f"{state_dir.rstrip('/')}/rows/{uuid.uuid4().hex}")
    return rows_at(docs, exact_groups(docs, id_col, text_col, state_dir=state_dir).where("kept").select("_file", "_row"), "left_semi").select(*docs.columns)
