"""Substring deduplication with repeated-phrase automata.

1. Candidates are found through anchors: every window of words has as its anchor the least hash of the short
   phrases in it, so equal windows have equal anchors.  Anchors that occur once cannot lie in a repeat.
2. Windows at recurring anchors whose hash occurs again are candidates; each gets a witness, another place of the
   same hash.  Consecutive windows with consecutive witnesses are one passage.  Anchors with few occurrences are
   handled in one task each; hot ones are counted by window, in parallel.
3. The words of each passage are read at its witness, once for all documents that name it, and sent to them.
4. The passages sent to a chunk of documents are a shard, compiled into an Aho-Corasick automaton that reads every
   document of the chunk.  A phrase that it locates anywhere but at the place it was read from recurs; only such
   phrases are removed, so a collision of hashes removes nothing.  Chunks and shards are bounded, whatever recurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import delete, free_shuffles, keyed, shared_dir, written
from bindery.llm.wordhash import rolling, text_hashes
from bindery.operators.skew import join_aggregated

WINDOW, PHRASE = 35, 10
#: Occurrences of an anchor beyond which its windows are counted in parallel.
HOT = 2000
#: Windows to a row at most; the bits of its mask.
ROW = 32
#: Words to a chunk of documents, about.
CHUNK = 400_000
_U = np.uint64


def _sliding_min(g: np.ndarray, k: int) -> np.ndarray:
    size = 1
    while 2 * size <= k:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (k - size)], g[k - size :]) if k > size else g


def _windows(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor) of every window, and the hash of every phrase, of at least ``window`` words' hashes."""
    g = rolling(h, phrase, 0xD6E8FEB86659FD93)
    g = (g ^ (g >> _U(32))) * _U(0x9E3779B97F4A7C15)
    g ^= g >> _U(29)
    return rolling(h, window, 0xA0761D6478BD642F), _sliding_min(g, window - phrase + 1), g


def _rows(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows with one anchor begin and end, runs cut to ``ROW`` windows."""
    edges = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]))
    sizes = np.diff(edges)
    cuts = -(-sizes // ROW)
    begins = np.repeat(edges[:-1], cuts) + ROW * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    return begins, np.minimum(begins + ROW, np.repeat(edges[1:], cuts))


def _anchor_rows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(anchor, n, _file, _row): each document's anchors; n is how many rows of windows they have, and 2 at least
    where a phrase repeats in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, counts, where = [], [], []
            for k, words in enumerate(text_hashes(batch.column(0))):
                if len(words) < window:
                    continue
                _, a, g = _windows(words, window, phrase)
                begins, _ = _rows(a)
                own, n = np.unique(a[begins], return_counts=True)
                s = np.sort(g)
                twice = s[1:][s[1:] == s[:-1]]
                anchors.append(own)
                counts.append(np.where(np.isin(own, twice), np.maximum(n, 2), n))
                where.append(np.full(len(own), k))
            if anchors:
                at = pa.array(np.concatenate(where))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], names=["anchor", "n", "_file", "_row"])

    return docs.select("text", "_file", "_row").mapInArrow(run, "anchor long, n long, _file long, _row long")


def _window_rows(docs: DataFrame, window: int, phrase: int, bits: int) -> DataFrame:
    """(anchor, hot, start, hashes, _file, _row): the windows at the anchors listed with each document."""
    mask = _U((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for k, (words, listed, hot) in enumerate(zip(text_hashes(part.column(0)), part.column(3), part.column(4), strict=True)):
                    h, a, _ = _windows(words, window, phrase)
                    begins, ends = _rows(a)
                    known = np.isin(a[begins], listed.values.to_numpy().view(_U))
                    begins, ends = begins[known], ends[known]
                    if not len(begins):
                        continue
                    spread = np.zeros(len(h) + 1, dtype=np.int64)
                    np.add.at(spread, begins, 1)
                    np.add.at(spread, ends, -1)
                    for column, value in zip(out, (a[begins], np.isin(a[begins], hot.values.to_numpy().view(_U)), begins, ends - begins, h[np.cumsum(spread[:-1]) > 0] & mask, np.full(len(begins), k)), strict=True):
                        column.append(value)
                if out[0]:
                    anchor, hot, start, sizes, hashes, where = (np.concatenate(x) for x in out)
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
                    place = pa.array(where)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(hot), pa.array(start.astype(np.int32)), lists, part.column(1).take(place), part.column(2).take(place)], names=["anchor", "hot", "start", "hashes", "_file", "_row"])

    return docs.select("text", "_file", "_row", "anchors", "hot_anchors").mapInArrow(run, "anchor long, hot boolean, start int, hashes array<long>, _file long, _row long")


SEGMENT = "_file long, _row long, start int, n int, w_file long, w_row long, w_start int"


def _segments(file: np.ndarray, row: np.ndarray, start: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """The columns of ``SEGMENT``: candidate windows of some rows of windows, with their witnesses.

    ``hashes`` are those of ``sizes[k]`` windows from ``start[k]`` on, row after row.  The witness of a window is the
    first place of its hash, or the last if that is its own.
    """
    which = np.repeat(np.arange(len(sizes)), sizes)
    bit = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[np.lexsort((start, row, file))] = np.arange(len(sizes))
    order = np.lexsort((rank[which] * (ROW + 1) + bit, hashes))
    edges = np.flatnonzero(np.concatenate(([True], hashes[order[1:]] != hashes[order[:-1]], [True])))
    counts = np.diff(edges)
    witness = np.empty(len(hashes), dtype=np.int64)
    witness[order] = np.repeat(order[edges[:-1]], counts)
    witness[order[edges[:-1]]] = order[edges[1:] - 1]
    at = np.flatnonzero(witness != np.arange(len(hashes)))
    own, other = which[at], which[witness[at]]
    begin, there = start[own] + bit[at], start[other] + bit[witness[at]]
    return _merged([file[own], row[own], begin, np.ones(len(at), dtype=np.int64), file[other], row[other], there])


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Segments that continue the one before them, at the witness too, as one."""
    file, row, start, n, w_file, w_row, w_start = columns
    if not len(start):
        return columns
    joins = (file[1:] == file[:-1]) & (row[1:] == row[:-1]) & (w_file[1:] == w_file[:-1]) & (w_row[1:] == w_row[:-1])
    joins &= (start[1:] == start[:-1] + n[:-1]) & (w_start[1:] == w_start[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~joins)))
    return [file[first], row[first], start[first], np.add.reduceat(n, first), w_file[first], w_row[first], w_start[first]]


def _segment_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SEGMENT.split(", ")])


def _witnessed(rows: DataFrame) -> DataFrame:
    """``SEGMENT`` from rows of windows that are dealt and sorted by anchor."""

    def tell(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("hashes").combine_chunks()
        file, row, start = (table.column(c).to_numpy().astype(np.int64) for c in ("_file", "_row", "start"))
        return _segment_batch(_segments(file, row, start, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            other = np.flatnonzero(anchors != anchors[-1])
            last = int(other[-1]) + 1 if len(other) else 0  # the group at the end may go on
            if held and last == 0 and held[-1].column("anchor")[-1].as_py() == anchors[0]:
                held.append(batch)
                continue
            if held or last:
                yield tell(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield tell(pa.Table.from_batches(held))

    return rows.select("anchor", "start", "hashes", "_file", "_row").mapInArrow(run, SEGMENT)


def _hot_witnessed(rows: DataFrame) -> DataFrame:
    """The same for anchors of any number of occurrences: places of windows, combined before the shuffle."""
    each = rows.select("anchor", "_file", "_row", F.posexplode("hashes").alias("bit", "hash"), "start")
    each = each.select("anchor", "hash", F.struct("_file", "_row", (F.col("start") + F.col("bit")).alias("start")).alias("place"))
    again = each.groupBy("anchor", "hash").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high")
    found = join_aggregated(each, again.hint("merge"), ["anchor", "hash"])
    witness = F.when(F.col("place") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return found.select("place", witness.alias("w")).select("place._file", "place._row", "place.start", F.lit(1).alias("n"), F.col("w._file").alias("w_file"), F.col("w._row").alias("w_row"), F.col("w.start").alias("w_start"))


def _joined_up(segments: DataFrame) -> DataFrame:
    """The segments of each document, those that continue each other as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _segment_batch(_merged([c.to_numpy().astype(np.int64) for c in batch.columns]))

    return segments.repartition("_file", "_row").sortWithinPartitions("_file", "_row", "start").mapInArrow(run, SEGMENT)


def _passages(docs: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """(w_file, w_row, w_start, n, words): the words at each witness that a segment names, once."""
    asked = segments.select("w_file", "w_row", "w_start", "n").distinct().groupBy("w_file", "w_row").agg(F.collect_list(F.struct("w_start", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[list] = [[], [], [], [], []]
                part = batch.slice(at, 500)
                for file, row, text, wanted in zip(part.column(0), part.column(1), part.column(2), part.column(3), strict=True):
                    words = text.as_py().split()
                    starts, sizes = (wanted.values.field(k).to_pylist() for k in range(2))
                    for start, n in zip(starts, sizes, strict=True):
                        for column, value in zip(out, (file.as_py(), row.as_py(), start, n, b" ".join(words[start : start + n - 1 + window])), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["w_file", "w_row", "w_start", "n", "words"])

    there = asked.withColumnsRenamed({"w_file": "_file", "w_row": "_row"})
    return docs.join(there.hint("merge"), ["_file", "_row"]).select("_file", "_row", "text", "asked").mapInArrow(run, "w_file long, w_row long, w_start int, n int, words binary")


def recurring(docs: DataFrame, folder: str, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, bits: int = 64) -> DataFrame:
    """(_file, _row, passages): for each document of (text binary, _file, _row), the passages that may recur in it.

    A passage has its words and the place where they were read: w_file, w_row, w_start.
    """
    spark = docs.sparkSession
    anchors = written(_anchor_rows(docs, window, phrase), folder, "anchors")
    again = anchors.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1")
    listed = join_aggregated(anchors, again, ["anchor"]).groupBy("_file", "_row").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("all") > hot, F.col("anchor"))).alias("hot_anchors"))
    listed = written(listed, folder, "listed")
    delete(spark, f"{folder}/anchors")
    free_shuffles(spark)
    rows = written(_window_rows(docs.join(listed, ["_file", "_row"]), window, phrase, bits), folder, "windows")
    free_shuffles(spark)
    few = _witnessed(rows.where("not hot").repartition(F.col("anchor")).sortWithinPartitions("anchor"))
    segments = written(few.unionAll(_hot_witnessed(rows.where("hot"))), folder, "segments")
    delete(spark, f"{folder}/windows")
    free_shuffles(spark)
    segments = written(_joined_up(segments), folder, "joined")
    passages = written(_passages(docs, segments, window), folder, "passages")
    free_shuffles(spark)
    told = join_aggregated(segments, passages.hint("merge"), ["w_file", "w_row", "w_start", "n"])
    return written(told.groupBy("_file", "_row").agg(F.collect_list(F.struct("words", "w_file", "w_row", "w_start")).alias("passages")), folder, "recurring")


class _Letters(dict):
    """Word -> code point from 1 on, anew for each chunk and its shard."""

    def __missing__(self, word: bytes) -> int:
        k = len(self) + 1
        self[word] = k = k if k < 0xD800 else k + 0x800
        return k


def locate(texts: list[list[bytes]], places: list[tuple[int, int]], passages: list[tuple[list[bytes], tuple[int, int, int]]], window: int = WINDOW) -> list[np.ndarray]:
    """Per text, whether each word lies in a phrase that recurs.

    ``places`` name the texts, and each of the ``passages`` has its words and the place where they were read: a text's
    name and the number of the first word there.  The automaton's phrases cover each passage end to end, in windows.
    It reads every text; a phrase found anywhere but where it was read recurs.  Words of no passage are letter 0.
    """
    letters = _Letters()
    spell = lambda codes, n: np.fromiter(codes, dtype="<u4", count=n).tobytes().decode("utf-32-le")
    phrases: dict[str, list[tuple[int, int, int]]] = {}
    for words, (file, row, start) in passages:
        text = spell(map(letters.__getitem__, words), len(words))
        for at in (*range(0, len(text) - window, window), len(text) - window):
            read = phrases.setdefault(text[at : at + window], [])
            if len(read) < 2 and (file, row, start + at) not in read:  # of two places, one is elsewhere
                read.append((file, row, start + at))
    covered = [np.zeros(len(words), dtype=bool) for words in texts]
    if phrases:
        automaton = ahocorasick.Automaton()
        for text, read in phrases.items():
            automaton.add_word(text, read)
        automaton.make_automaton()
        for words, own, (file, row) in zip(texts, covered, places, strict=True):
            reach = -1
            for end, read in automaton.iter(spell(map(letters.get, words, repeat(0)), len(words))):
                begin = end - window + 1
                if len(read) > 1 or read[0] != (file, row, begin):
                    own[max(reach + 1, begin) : end + 1] = True
                    reach = end
    return covered


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, with_text: bool = True, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, text): every row of ``docs`` without its repeats.

    Removed is each word covered by ``window`` consecutive words of one document whose sequence also starts
    anywhere else, the same document included, judged on the input.  Words are runs of anything but ASCII white
    space; ``spans`` are the removed words as (start, end), end exclusive; the text is the kept words, one space
    apart, or null without ``with_text``.  Null and empty texts have no words; repeated rows repeat each other;
    null ids keep their rows; other columns are ignored; an empty table gives an empty result.  ``bits`` below 64
    makes hashes collide, for tests: a collision may hide a repeat, but removes nothing that does not recur.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase has at least one word and at most as many as a window")
    folder = shared_dir(docs.sparkSession, "substrings")
    rows = keyed(docs, [id_col, text_col], folder).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), "_file", "_row")
    found = recurring(rows, folder, window, phrase, hot, bits)
    free_shuffles(docs.sparkSession)

    def finish(ids: list[int | None], places: list[tuple[int, int]], texts: list[list[bytes]], passages: list) -> pa.RecordBatch:
        out: list[list] = [ids, [], [], [], [], []]
        for words, gone in zip(texts, locate(texts, places, passages, window), strict=True):
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2).tolist()
            for column, value in zip(out[1:], (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in edges], kept.decode("utf-8", "replace") if with_text else None), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, texts, passages, held = [], [], [], [], 0
        for batch in batches:
            named = zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True)
            for doc, file, row, text, sent in named:
                words = (text.as_py() or b"").split()
                ids.append(doc)
                places.append((file, row))
                texts.append(words)
                held += len(words)
                if sent.is_valid:
                    fields = [sent.values.field(k).to_pylist() for k in range(4)]
                    passages += [(body.split(), at) for body, at in zip(fields[0], zip(*fields[1:], strict=True), strict=True)]
                if held >= CHUNK:
                    yield finish(ids, places, texts, passages)
                    ids, places, texts, passages, held = [], [], [], [], 0
        if ids:
            yield finish(ids, places, texts, passages)

    return rows.join(found.hint("merge"), ["_file", "_row"], "left").select("id", "_file", "_row", "text", "passages").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, text string")
