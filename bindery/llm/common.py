"""What the operators share: the shared folder, written tables, row keys and word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Intermediate tables need no success mark; on a local file system each costs the driver a process.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a temporary folder takes its place in local mode alone; a cluster must name one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="bindery-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").options(**UNMARKED).parquet(path := f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now.

    Its cleaner waits until the driver's collector finds that nothing refers to a shuffle, by itself every half hour,
    and until then the files of all phases lie side by side on the executors' disks.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def on_files(df: DataFrame, folder: str) -> DataFrame:
    """``df``, if its rows are those of files that can be located; else a copy written to the shared folder."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema
        return df
    except AnalysisException:
        return written(df, folder, "rows")


def keyed(df: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """The columns and a unique, repeatable row key (``_file``, ``_row``), whatever the other columns hold.

    Rows of Parquet files are known by file and position.  Rows of any other plan are first written to the
    shared folder, so that a later scan sees the same rows under the same keys.
    """
    df = on_files(df, folder) if columns == df.columns else on_files(df.select(*columns), folder)
    place = df.metadataColumn("_metadata")
    return df.select(*columns, F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_row"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each made longer until no column in ``taken`` has it in any case."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def rows_at(df: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``df``, read from files, joined with ``places`` by their ``_file`` and ``_row``.

    The other columns of ``places`` must not clash with those of ``df``; see ``fresh``.
    """
    place = df.metadataColumn("_metadata")
    own_file, own_row, at_file, at_row = fresh([*df.columns, *places.columns], "own_file", "own_row", "at_file", "at_row")
    own = df.select("*", F.xxhash64(place["file_path"]).alias(own_file), place["row_index"].alias(own_row))
    there = places.withColumnsRenamed({"_file": at_file, "_row": at_row})
    return own.join(there, (F.col(own_file) == F.col(at_file)) & (F.col(own_row) == F.col(at_row)), how).drop(own_file, own_row, at_file, at_row)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
