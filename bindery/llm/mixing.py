"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import WORD, fresh, keyed, on_files, rows_at, shared_dir, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
#: Documents to a bin, about: bins bound what one task sorts.
BIN_ROWS = 1000
#: Times that many rows make a bin large: it is cut by file and position.
LARGE = 8
_RANGE = 1 << 60


def words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n, target) from (source, size, n), by water-filling.

    Sources above the cap are clamped to it and their excess is shared again among the rest by weight, until no
    source is above.  One row per source; each round brings three sums to the driver.  The only window without
    a partition ranks the sources, one short row each.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    table = written(sizes.select("source", "size", "n", weight.alias("weight")), folder, "sources")
    cap = F.col("size") * max_epochs
    total = table.agg(F.sum("size")).first()[0] or 0
    level = 0.0
    capped = F.lit(False)
    while True:
        rest = table.agg(F.sum(F.when(capped, cap).otherwise(0)).alias("held"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")).first()
        if not rest.weight:
            break
        level = (total * share - rest.held) / rest.weight
        over = F.lit(level) * F.col("weight") > cap
        if not table.where(over & ~capped).limit(1).count():
            break
        capped = F.lit(level) * F.col("weight") > cap
    target = F.when(capped, cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", F.col("size").alias("source_size"), "n", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(id, size, source, source_size, target, taken, copies, extra, _file, _row) of every row of ``docs``.

    ``copies`` whole repetitions and, in a seeded order of the documents, one more until the source's target is
    met; the last of these is a fractional repetition of its first ``extra`` words.  So the words taken from a
    source equal its target, rounded, and no document exceeds ``max_epochs`` times its size.  A null source is a
    source of its own; null, empty and blank texts have size 0 and take 0; a null id takes part under one key;
    repeated rows each count.  An empty table gives an empty result.  The order depends on seed and id alone, but for
    bins that repeated or null ids make large, which are ordered by their rows' files and positions.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "mixing")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    rows = keyed(docs, list(dict.fromkeys([id_col, text_col, source_col])), folder).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), "_file", "_row")
    rows = written(rows.withColumn("h", order), folder, "sizes")
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), folder, weights, share, max_epochs), folder, "targets")
    want = F.floor(F.col("target") + 0.5)
    copies = F.when(F.col("source_size") > 0, F.floor(want / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    plan = sources.select(F.col("source").alias("s"), "source_size", "target", copies.alias("copies"), (want - copies * F.col("source_size")).alias("rest"), F.ceil(F.col("n") / BIN_ROWS).alias("bins"))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("bin", F.floor(F.col("h") / (F.lit(_RANGE) / F.col("bins"))))
    sizes = written(placed.groupBy(F.col("s").alias("s2"), F.col("bin").alias("bin2")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows")), folder, "bins")
    placed, sizes = placed.withColumn("sub", F.lit(0).cast("long")), sizes.withColumn("sub2", F.lit(0).cast("long"))
    large = sizes.where(F.col("rows") > LARGE * BIN_ROWS)
    if not large.isEmpty():
        cuts = large.select(F.col("s2").alias("s3"), F.col("bin2").alias("bin3"), F.ceil(F.col("rows") / BIN_ROWS).alias("cuts")).hint("merge")
        spread = F.pmod(F.xxhash64("_file", "_row", F.lit(seed)), F.lit(_RANGE))
        cut = placed.join(cuts, F.col("s").eqNullSafe(F.col("s3")) & (F.col("bin") == F.col("bin3")), "left")
        placed = cut.withColumn("h", F.when(F.col("cuts").isNull(), F.col("h")).otherwise(spread)).withColumn("sub", F.when(F.col("cuts").isNull(), 0).otherwise(F.floor(F.col("h") / (F.lit(_RANGE) / F.col("cuts"))))).drop("s3", "bin3", "cuts")
        sizes = placed.groupBy(F.col("s").alias("s2"), F.col("bin").alias("bin2"), F.col("sub").alias("sub2")).agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("s2").orderBy("bin2", "sub2").rowsBetween(Window.unboundedPreceding, -1)
    bins = sizes.select("s2", "bin2", "sub2", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("bin_from"))
    within = Window.partitionBy("s", "bin", "sub").orderBy("h", "id", "_file", "_row").rowsBetween(Window.unboundedPreceding, -1)
    told = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bins, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bin") == F.col("bin2")) & (F.col("sub") == F.col("sub2")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("bin_from") - F.col("before")))
    return told.withColumn("extra", extra.cast("long")).select("id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"), "copies", "extra", "_file", "_row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents of the mix, with all their columns: a row for each whole or fractional repetition.

    A fractional repetition holds the first words of its text, one space apart.  Documents of size 0 (null, empty or
    blank texts) have no words to share and stay once; null sources and ids, repeated rows and empty tables are treated
    as by ``mix``.  Columns of any name are kept.
    """
    docs = on_files(docs, shared_dir(docs.sparkSession, "mixing"))
    size, copies, extra, n, turn = fresh(docs.columns, "size", "copies", "extra", "n", "turn")
    taken = mix(docs, id_col, text_col, source_col, **settings).select("_file", "_row", F.col("size").alias(size), F.col("copies").alias(copies), F.col("extra").alias(extra))
    part = (F.col(extra) > 0) & (F.col(extra) < F.col(size))
    times = F.when(F.col(size) == 0, 1).otherwise(F.col(copies) + (F.col(extra) > 0).cast("int")).cast("int")
    repeated = rows_at(docs, taken, "inner").withColumn(n, times).where(F.col(n) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n))))
    first = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), 1), F.lit(1), F.col(extra).cast("int")), " ")
    text = F.when(part & (F.col(turn) == F.col(n)), first).otherwise(F.col(text_col))
    return repeated.withColumn(text_col, text).select(*docs.columns)


#: The same rows by DuckDB: the capped sources are those before the first, by size to weight, that fits.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS r,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
    sum(source_size) OVER () AS total
  FROM s),
lev AS (SELECT *, (total * CAST(1.5 AS DOUBLE) - 2 * before) / left_w AS level FROM o),
f AS (SELECT min(r) AS r FROM lev WHERE level * w <= 2 * source_size),
t AS (
  SELECT lev.source, source_size, w,
    CASE WHEN lev.r < f.r OR f.r IS NULL THEN CAST(2 * source_size AS DOUBLE) ELSE (SELECT level FROM lev l2, f f2 WHERE l2.r = f2.r) * w END AS target
  FROM lev, f),
p AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.want,
    CASE WHEN p.source_size > 0 THEN p.want // p.source_size ELSE 0 END AS copies,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(copies * size + greatest(0, least(size, want - copies * source_size - before)) AS BIGINT) AS taken
FROM c
"""
