"""Cost-balanced packing of token ids into sequences of fixed length.

A sequence's cost is the estimated attention work of its pieces: a linear term and a quadratic one.  Documents
go, in descending order of length, to the lowest-cost sequence with remaining token capacity.  Documents are
dealt by row to shards of about ``SHARD_BYTES`` of text, and each shard is packed by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.encoding import encoder

LENGTH = 1024
END = 0
#: Width of the model whose cost is estimated: per token, linear work is 6 * WIDTH times one attended position.
WIDTH = 1024
SHARD_BYTES = 2_500_000
#: Shards to a task, about.
TASK_SHARDS = 4
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: np.ndarray | int) -> np.ndarray | float:
    """Linear plus quadratic attention cost of a piece, in units of one token's linear work."""
    return length + length * length / (6.0 * WIDTH)


def plan(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, piece length, sequence, offset) for documents of the given sizes.

    Whole multiples of ``length`` fill sequences of their own.  The remainders go, longest first, to the
    lowest-cost sequence that has room; one that fits nowhere is cut to fill the sequence with most room.  There
    are as few sequences as hold all ids, so only one is not full.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    at, rests = 0, []
    for doc, size in enumerate(sizes):
        whole = size // length
        for k in range(whole):
            pieces.append((doc, k * length, length, at, 0))
            at += 1
        if size % length:
            rests.append((doc, whole * length, size % length))
    rests.sort(key=lambda r: (-r[2], r[0]))
    total = sum(r[2] for r in rests)
    n = -(-total // length)
    room = np.full(n, length, dtype=np.int64)
    if n:
        room[-1] = total - (n - 1) * length
    limit = room.copy()
    spent = np.zeros(n)
    for doc, start, size in rests:
        while size:
            fits = room >= size
            if fits.any():
                to = int(np.argmin(np.where(fits, spent, np.inf)))
                took = size
            else:
                to = int(np.argmax(room))
                took = int(room[to])
            pieces.append((doc, start, took, at + to, int(limit[to] - room[to])))
            room[to] -= took
            spent[to] += cost(took)
            start, size = start + took, size - took
    return pieces


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The pieces of all rows of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids by the tokenizer file and ``end``.  A null or empty text is ``end`` alone; repeated
    rows are documents of their own; a null id stays null; other columns are ignored.  An empty table gives no
    pieces.  Rows are dealt by position, so no id makes a shard large, and there are as many tasks as shards ask
    for; repeated and null ids are ordered by their ids.  A very long text is held whole in one task, as its ids.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        last = own.bytes_of([end])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array([own.encode(x.as_py() or "") + last for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["shard", "id", "ids"])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, dtype = key[0].as_py(), encoder(tokenizer).dtype
        rows = table.sort_by([("id", "ascending"), ("ids", "ascending")]) if table.num_rows > 1 else table
        doc_ids = rows.column("id").to_pylist()
        ids = [np.frombuffer(x.as_py(), dtype).astype("<u4") for x in rows.column("ids")]
        out: list[list[int]] = [[], [], [], [], [], [], []]
        for doc, start, took, sequence, offset in plan([len(x) for x in ids], length):
            for column, value in zip(out, (doc_ids[doc], start, took, zlib.crc32(ids[doc][start : start + took]), len(ids[doc]), sequence * shards + shard, offset), strict=True):
                column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in PIECES.split(", ")])

    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    rows = docs.select(shard.alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    encoded = rows.mapInArrow(encode, "shard long, id long, ids binary")
    return encoded.repartition(-(-shards // TASK_SHARDS), "shard").groupBy("shard").applyInArrow(pack, PIECES)
