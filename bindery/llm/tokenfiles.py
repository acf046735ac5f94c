"""Token ids in shards compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents.  Frequent pairs of ids are repeatedly replaced by nonterminals;
each round replaces every pair that is frequent enough, the more frequent first where occurrences overlap, until
no pair is.  A shard stores the remaining symbols, the rules and the expansion length of each rule, so that any document, or
any span of one, is decoded without the rest.  Shards are rows of a Parquet dataset: Spark writes and reads them
in any store, and a lost executor's shards are written again.

Layout of a shard, little-endian: magic ``RPG1``; uint32 documents, rules, terminals, symbols; uint32 ids and
uint32 symbols of each document; uint32 left, right and expansion length of each rule; then the symbols, two
bytes wide if terminals and rules number at most 65,536, four otherwise.  Symbol ``terminals + k`` is rule k.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import UNMARKED, shared_dir
from bindery.llm.encoding import encoder

END = 2
MAGIC = b"RPG1"
#: Ids to a shard, about; uses below which a pair gets no rule.
SHARD_IDS = 1 << 20
LEAST = 16
#: Pieces in a worker's cache, some 200 bytes each; those that are not there take most of the time.
PIECES = 1_200_000
SHARDS = "part long, seq long, first_id long, start_in_part long, n_ids long, doc_ids array<long>, payload binary"


def compress(ids: np.ndarray, last: np.ndarray, terminals: int, rounds: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules): ``last`` marks the final symbol of each document; no rule crosses documents.

    Symbols are a linked list over their first positions, where n stands for no neighbour.  A pair that is rare
    stays rare, for only new symbols make new pairs, so a round looks at the ``live`` positions alone: those whose
    pair is new or was frequent and overlapped by a better one.  Pairs are counted in hashed slots; of pairs that
    share a slot one is counted in this round and the others, by another hash, in the next.  The rounds end when no
    pair has ``least`` uses; ``rounds`` can end them earlier.  Of a run of one symbol, whose pairs overlap, every other pair is replaced.
    """
    n = len(ids)
    symbols = np.append(ids.astype(np.uint32), np.uint32(0))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    ends = np.flatnonzero(last)
    after[ends] = before[ends + 1] = before[0] = n
    alive, mark = np.ones(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    rules, size, turn = [np.zeros((0, 2), dtype=np.int64)], terminals, 0
    live = np.flatnonzero(after[:n] < n).astype(np.int32)
    while len(live) and (rounds is None or turn < rounds):
        bits = min(20, max(8, (4 * len(live)).bit_length()))
        left, right = symbols[live], symbols[after[live]]
        slot = ((left * np.uint32(0x9E3779B1) ^ right) * np.uint32((0x85EBCA77 + 2 * turn * 0x3C6EF372) % (1 << 32))) >> np.uint32(32 - bits)
        turn += 1
        hot = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] >= least)
        live, slot = live[hot], slot[hot]
        keys = left[hot].astype(np.uint64) << np.uint64(32) | right[hot]
        owner = np.empty(1 << bits, dtype=np.uint64)
        owner[slot] = keys
        own = owner[slot] == keys
        unsure, live, slot = live[~own], live[own], slot[own]
        counts = np.bincount(slot, minlength=1 << bits)
        frequent = np.flatnonzero(counts >= least)
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
        none = len(frequent)
        ranked = np.full(1 << bits, none, dtype=np.int32)
        ranked[frequent] = np.arange(none, dtype=np.int32)
        ranks = ranked[slot]
        live, ranks = live[ranks < none], ranks[ranks < none]
        touch = after[live[:-1]] == live[1:]
        begins = np.append(True, ~touch | (ranks[1:] != ranks[:-1]))[: len(live)]
        above = np.append(True, ~touch | (ranks[1:] < ranks[:-1]))[: len(live)]
        below = np.append(~touch | (ranks[:-1] <= ranks[1:]), True)[: len(live)]
        at = np.arange(len(live))
        run = np.maximum.accumulate(np.where(begins, at, 0))
        chosen = np.where(begins, above, (at - run) % 2 == 0) & below
        heads, used = live[chosen], ranks[chosen]
        worth = np.flatnonzero(np.bincount(used, minlength=none) >= min(3, least))
        number = np.zeros(none, dtype=np.uint32)
        number[worth] = size + np.arange(len(worth))
        heads, used = heads[number[used] > 0], used[number[used] > 0]
        if not len(heads):
            live = unsure
            continue
        pairs = owner[frequent[worth]]
        rules.append(np.stack((pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)), axis=1).astype(np.int64))
        size += len(worth)
        gone = after[heads]
        behind = after[gone]
        symbols[heads], after[heads] = number[used], behind
        before[behind] = heads
        for some in (live, unsure, heads, before[heads]):
            mark[some] = True
        alive[gone] = mark[gone] = mark[n] = False
        live = np.flatnonzero(mark).astype(np.int32)
        mark[live] = False
        live = live[after[live] < n]
    alive[n] = False
    return symbols[alive], after[alive] == n, np.concatenate(rules)


def _levels(left: np.ndarray, right: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that are made of earlier symbols only."""
    latest, first = np.maximum.accumulate(np.maximum(left, right)), 0
    while first < len(latest):
        last = int(np.searchsorted(latest, terminals + first))
        yield first, last
        first = last


def write_shard(documents: list[np.ndarray], terminals: int, rounds: int | None = None, least: int = LEAST) -> bytes:
    """The shard of some documents' ids; a document may be empty."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype=np.int64)
    last = np.zeros(len(ids), dtype=bool)
    last[(np.cumsum(sizes) - 1)[sizes > 0]] = True
    symbols, last, rules = compress(ids, last, terminals, rounds, least)
    n_symbols = np.zeros(len(sizes), dtype=np.int64)
    n_symbols[sizes > 0] = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    spans = np.ones(terminals + len(rules), dtype=np.int64)
    for s, e in _levels(rules[:, 0], rules[:, 1], terminals):
        spans[terminals + s : terminals + e] = spans[rules[s:e]].sum(axis=1)
    wide = "<u2" if len(spans) <= 1 << 16 else "<u4"
    head = struct.pack("<4s4I", MAGIC, len(sizes), len(rules), terminals, len(symbols))
    return head + b"".join(x.astype("<u4").tobytes() for x in (sizes, n_symbols, rules[:, 0], rules[:, 1], spans[terminals:])) + symbols.astype(wide).tobytes()


class Shard:
    """A shard opened for random access."""

    def __init__(self, payload: bytes) -> None:
        magic, docs, rules, terminals, symbols = struct.unpack_from("<4s4I", payload)
        if magic != MAGIC:
            raise ValueError("not a shard")
        fields, at = [], 20
        for n in (docs, docs, rules, rules, rules):
            fields.append(np.frombuffer(payload, "<u4", n, at).astype(np.int64))
            at += 4 * n
        self.sizes, n_symbols, self.left, self.right, lengths = fields
        wide = "<u2" if terminals + rules <= 1 << 16 else "<u4"
        self.symbols = np.frombuffer(payload, wide, symbols, at)
        self.terminals, self.bounds = terminals, np.concatenate(([0], np.cumsum(n_symbols)))
        self.spans = np.concatenate((np.ones(terminals, dtype=np.int64), lengths))
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions one after the other, and where each symbol's begins."""
        if self._flat is None:
            starts = np.concatenate(([0], np.cumsum(self.spans)[:-1]))
            flat = np.empty(int(self.spans.sum()), dtype=np.uint32)
            flat[: self.terminals] = np.arange(self.terminals)
            for s, e in _levels(self.left, self.right, self.terminals):
                parts = np.stack((self.left[s:e], self.right[s:e]), axis=1).ravel()
                n, at = self.spans[parts], starts[self.terminals + s]
                ends = np.cumsum(n)
                flat[at : at + ends[-1]] = flat[np.arange(ends[-1]) + np.repeat(starts[parts] - ends + n, n)]
            self._flat = flat, starts
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self._expansions()
        n = self.spans[symbols]
        ends = np.cumsum(n)
        if not len(ends):
            return np.zeros(0, dtype=np.uint32)
        return flat[np.arange(ends[-1]) + np.repeat(starts[symbols] - ends + n, n)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.bounds[k] : self.bounds[k + 1]])

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document k; only the symbols that reach into the span are expanded."""
        own = self.symbols[self.bounds[k] : self.bounds[k + 1]]
        ends = np.cumsum(self.spans[own])
        first, final = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = ends[first - 1] if first else 0
        return self.expand(own[first:final])[start - before : stop - before]

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all rows of ``docs`` at ``path``, in ascending order of id, nulls first.

    A null or empty text is ``end`` alone; repeated ids are documents of their own, ordered by a hash of the text
    and the text, so that no id makes a task large.  Other columns are ignored.  A shard ends at the first document that brings it to ``shard_ids`` ids, so a task holds
    one shard and one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq, start = encoder(tokenizer, PIECES), TaskContext.get().partitionId(), 0, 0
        terminals = max(own.library.get_vocab_size(), end + 1)
        last = own.bytes_of([end])
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            row = [[part], [seq], [names[0]], [start], [held], [names], [write_shard(ids, terminals)]]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                ids.append(np.frombuffer(own.encode(text.as_py() or "") + last, own.dtype))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield shard()
                    names, ids, seq, start, held = [], [], seq + 1, start + held, 0
        if names:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, SHARDS).write.options(**UNMARKED).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files at ``path``, decoded from the shards.

    Null and repeated ids are documents like others, in the order in which they were written; files without documents
    give no rows; a shard is decoded whole in one task, however long its documents are.

    ``start`` adds the ids of earlier partitions, one row per written partition, which is all that is broadcast
    and all that a window without a partition orders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, names, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                shard, start = Shard(payload.as_py()), at.as_py()
                found = shard.documents()
                begins = start + np.concatenate(([0], np.cumsum(shard.sizes)[:-1]))
                crcs = [zlib.crc32(d.astype("<u4", copy=False)) for d in found]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(found), pa.int64()), pa.array(names.as_py(), pa.int64()), pa.array(begins, pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    decoded = shards.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(run, "part long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back; see ``write_tokens``."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark, 'tokens')}/shards"
    write_tokens(docs, path, tokenizer, id_col, text_col, end)
    return read_tokens(spark, path)
