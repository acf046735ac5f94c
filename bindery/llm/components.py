"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import delete, written
from bindery.operators.skew import join_aggregated


def _nearest(edges: DataFrame) -> DataFrame:
    """(a, b, low): each row with the smallest neighbour of its a.

    Minima are combined before the shuffle; both sides are sorted, so that rounds send nothing to the driver.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return join_aggregated(edges, low.hint("merge"), ["a"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return _nearest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    to_low = F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))
    return _nearest(down).select(F.inline(to_low)).where("a <> b").distinct()


def components(edges: DataFrame, folder: str, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has two integer columns without nulls.  Each round is written to the shared folder,
    so lineage stays short, and replaces the one before it; only its count and checksum reach the driver.  The rounds grow with
    the logarithm of the longest chain.  A hub's rows are joined with one minimum, which Spark can split.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), folder, f"{name}-0")
    seen = None
    for k in range(1, max_rounds + 1):
        now = written(_small_star(_large_star(now)), folder, f"{name}-{k}")
        delete(now.sparkSession, f"{folder}/{name}-{k - 1}")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
