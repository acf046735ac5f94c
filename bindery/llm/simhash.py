"""SimHash near-duplicates through the anchor points of a covering code.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most one bit of their upper or of their
lower half.  The anchors of a half are the 2**26 words of the Hamming code [31, 26] over its first 31 bits;
the code has covering radius 1, so each half lies within 1 of exactly one anchor, its home.  A fingerprint is
replicated to every anchor within covering radius plus threshold, 1 + 1 = 2: its home and at most 15 others.
If x and y differ in one bit of a half, y lies within 2 of x's home, so they meet there and no link is lost.
Per anchor, the fingerprints at home are compared with all that were replicated to it, on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import keyed, on_files, rows_at, shared_dir, written
from bindery.llm.components import components
from bindery.operators.skew import join_aggregated

SEED = 42
THRESHOLD = 3
#: Positions 1 to 31 of the Hamming code; bit b of the syndrome is the parity of the positions that have bit b.
LENGTH = 31
CHUNK = 1 << 16


def _votes(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How many shingles set each of the 64 bits, most significant first, and the number of shingles."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    digest, votes = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    last = ends[-n:].tolist()
    first = starts[:n].tolist()
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
        for k in range(0, len(bits), 255):
            votes += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return votes, n


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    votes, n = _votes(words, shingle)
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, _file, _row, fp) from (id, _file, _row, text); null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(3)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps)], names=["id", "_file", "_row", "fp"])

    return rows.select("id", "_file", "_row", F.col("text").cast("binary")).mapInArrow(run, "id long, _file long, _row long, fp long")


def _anchors(half: Column, which: int) -> Column:
    """The anchors within 2 of a half, its home first.  Bit i - 1 of the half is position i of the code."""
    word = half.bitwiseAND((1 << LENGTH) - 1)
    syndrome = sum((F.bit_count(word.bitwiseAND(sum(1 << (i - 1) for i in range(1, LENGTH + 1) if i >> b & 1))) % 2) * (1 << b) for b in range(5))
    flip = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int")))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(LENGTH)), lambda i: (i.bitwiseXOR(syndrome.cast("int")) > i) & (syndrome != 0))
    home = word.bitwiseXOR(flip(syndrome))
    others = F.transform(pairs, lambda i: word.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(syndrome.cast("int")))))
    return F.transform(F.concat(F.array(home), others), lambda a: a.bitwiseOR(F.lit(which << LENGTH).cast("long")))


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, home, fp): each distinct fingerprint at every anchor within covering radius plus threshold."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    both = fps.select("fp", F.explode(F.array(_anchors(low, 0), _anchors(high, 1))).alias("anchors"))
    return both.select("fp", F.posexplode("anchors").alias("pos", "anchor")).select("anchor", (F.col("pos") == 0).alias("home"), "fp")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): every pair of distinct fingerprints that differ in at most ``threshold`` (up to 3) bits.

    A fingerprint has at most 43,744 others within 3 bits, so no group of copies makes the links quadratic.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the covering code serves thresholds from 0 to 3")
    at = anchored(fps)
    home = at.where("home").select("anchor", F.col("fp").alias("a"))
    near = at.select("anchor", F.col("fp").alias("b"))
    return home.join(near.hint("merge"), (home.anchor == near.anchor) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(id, fp, component_id, kept, _file, _row): the near-duplicate group of every row of ``docs``.

    component_id is the smallest id reachable through links, itself included; one row of that id is ``kept``, the
    first by file and position.  Equal fingerprints are one node, so copies of any number cost one comparison.
    Null, empty and blank texts have fingerprint 0 and are linked like any other; a null id takes part but never
    names a group unless all ids of the group are null; repeated rows and repeated ids each get their row.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "simhash")
    rows = written(fingerprints(keyed(docs, [id_col, text_col], folder).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), "_file", "_row"), shingle), folder, "fps")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")
    classes = written(rows.groupBy("fp").agg(F.min(place).alias("rep")), folder, "classes")
    found = written(links(classes.select("fp"), threshold), folder, "links")
    roots = components(found, folder)
    named = classes.join(roots.hint("merge"), classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("low"))
    named = written(join_aggregated(named, lowest, ["root"]).select("fp", "low"), folder, "named")
    kept = (F.col("low._file") == F.col("_file")) & (F.col("low._row") == F.col("_row"))
    return rows.join(named.hint("merge"), "fp").select("id", "fp", F.col("low.id").alias("component_id"), kept.alias("kept"), "_file", "_row")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Nulls, empty and blank texts, ties, repeated rows and empty tables are treated as by ``near_duplicates``; texts of
    any length are read whole.
    """
    docs = on_files(docs, shared_dir(docs.sparkSession, "simhash"))
    return rows_at(docs, near_duplicates(docs, id_col, text_col).where("kept").select("_file", "_row"), "left_semi").select(*docs.columns)
