"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of two rows of a hashed table, for the word and for its first letters.  Filters of
several widths run over the words, each is max-pooled over the whole text, and a logistic layer scores the
pooled values.  A threshold per language, which is told from the text's own function words, is calibrated on
training rows that the fit does not see and moves the score so that 0.5 is that threshold.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that was it for on with be this are from",
    "fr": "le la les des et est que qui une dans pour pas sur du",
    "de": "der die das und ist nicht ein eine mit zu von den auf sich",
    "es": "el los las que y en un una por con para no se del",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
FOLDS = 5
#: Rows of either class that training takes at most.
TOXIC_ROWS, CLEAN_ROWS = 2000, 3000
#: Bytes of whole texts that training takes at most.
TRAIN_BYTES = 64 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 12, 6, (1, 2, 3)
PAD = max(WIDTHS) - 1
PREFIX = 4
#: Few rows are seen more often, for ``LEAST_STEPS`` batches in all.
EPOCHS, BATCH, RATE, LEAST_STEPS = 6, 64, 0.02, 500
SEED = 7
_STRIP = b".,;:!?\"'()[]{}*#$%&"


class Vocabulary(dict):
    """Word -> index; ``rows`` has two table rows for each, of the word and of its prefix, ``language`` its language."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit
        self.known = {w.encode(): k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
        self.reset()

    def reset(self) -> None:
        self.clear()
        #: Index 0 pads; its rows are the table's last, which stays zero.
        self.rows = array("q", [BUCKETS, BUCKETS])
        self.language = array("b", [len(FUNCTION_WORDS)])

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(_STRIP).decode("utf-8", "replace").lower()
        h = xxhash.xxh64_intdigest
        self[word] = k = len(self.language)
        self.rows.append(h("w" + plain) % BUCKETS)
        self.rows.append(h("p" + plain[:PREFIX]) % BUCKETS)
        self.language.append(self.known.get(plain.encode(), len(FUNCTION_WORDS)))
        return k

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word indices of the texts, each padded behind, and where each text begins."""
        flat = array("i")
        starts = []
        for text in texts:
            starts.append(len(flat))
            flat.extend(map(self.__getitem__, (text or b"").split()))
            flat.extend([0] * (PAD + 1))
        return np.frombuffer(flat, dtype=np.int32), np.array(starts, dtype=np.int64)


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS + 1, DIM), the last row zero
    filters: list[np.ndarray]  # per width, (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # per language, in logits

    def packed(self) -> bytes:
        """The model without the rows of words that training never saw."""
        used = np.flatnonzero(self.table.any(axis=1))
        return pickle.dumps((used.astype(np.int32), self.table[used], self.filters, self.bias, self.out, self.out_bias, self.thresholds))

    @staticmethod
    def unpacked(data: bytes) -> Model:
        used, rows, *rest = pickle.loads(data)
        table = np.zeros((BUCKETS + 1, DIM), np.float32)
        table[used] = rows
        return Model(table, *rest)

    def maps(self, x: np.ndarray) -> np.ndarray:
        """(words, all filters): each filter's value on the words from each position on."""
        parts = []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            z = x @ kernel[0]
            for j in range(1, w):
                z[:-j] += x[j:] @ kernel[j]
            parts.append(z)
        return np.concatenate(parts, axis=1) + self.bias

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def values(self, words: Vocabulary, at: int) -> list[np.ndarray]:
        """For words from index ``at`` on: what each adds to the filters as their first, second ... word."""
        rows = np.array(words.rows[2 * at :], dtype=np.int64).reshape(-1, 2)
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        return [x @ np.concatenate([k[j] for k in self.filters if len(k) > j], axis=1) for j in range(max(WIDTHS))]


class Scorer:
    """Scores texts by a model; what a word adds to the filters is computed once while it is in the vocabulary."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, Vocabulary()
        self.known, self.values, self.language = 0, [np.zeros((0, 0), np.float32)] * max(WIDTHS), np.zeros(0, dtype=np.int64)

    def _learn(self) -> None:
        n = len(self.words.language)
        if n < self.known or not self.known:
            self.known = 0
        if n > self.known:
            if n > len(self.language) or not self.known:
                room = max(1 << 14, 2 * n)
                values, language = [np.zeros((room, FILTERS * (len(WIDTHS) - j)), np.float32) for j in range(max(WIDTHS))], np.zeros(room, dtype=np.int64)
                for new, old in zip(values, self.values, strict=True):
                    if self.known:
                        new[: self.known] = old[: self.known]
                language[: self.known] = self.language[: self.known]
                self.values, self.language = values, language
            for table, value in zip(self.values, self.model.values(self.words, self.known), strict=True):
                table[self.known : n] = value
            self.language[self.known : n] = self.words.language[self.known :]
            self.known = n

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        if len(self.words.language) > self.words.limit:
            self.words.reset()
            self.known = 0
        flat, starts = self.words.texts(texts)
        self._learn()
        if not len(starts):
            return np.zeros(0)
        model, pooled = self.model, []
        for i, j, a, b in _pieces(starts, len(flat)):
            own = flat[a:b]
            z = self.values[0][own]
            for k in range(1, max(WIDTHS)):
                z[:-k, FILTERS * k :] += self.values[k][own[k:]]
            z[_tails(np.append(starts[i + 1 : j], b) - a)] = -np.inf
            pooled.append(np.maximum.reduceat(z, starts[i:j] - a, axis=0))
        logits = model.logits(np.concatenate(pooled) + model.bias)
        spoken = self.language[flat]
        heard = np.flatnonzero(spoken < len(FUNCTION_WORDS))
        which = np.searchsorted(starts, heard, "right") - 1
        seen = np.bincount(which * len(FUNCTION_WORDS) + spoken[heard], minlength=len(starts) * len(FUNCTION_WORDS)).reshape(-1, len(FUNCTION_WORDS))
        language = np.where(seen.max(axis=1) > 0, seen.argmax(axis=1), len(FUNCTION_WORDS))
        return 1 / (1 + np.exp(-np.clip(logits - model.thresholds[language], -500, 500)))


def _tails(ends: np.ndarray) -> np.ndarray:
    """The last positions of each text, from where filters would reach into the next one."""
    return (ends[:, None] - np.arange(1, PAD + 1)).ravel()


def _pieces(starts: np.ndarray, n: int, words: int = 100_000) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts of about so many words: (first text, text behind, first word, word behind)."""
    i, ends = 0, np.append(starts[1:], n)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + words, "right")))
        yield i, j, int(starts[i]), int(ends[j - 1])
        i = j


def _shared(rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' table rows, with those that only one text has replaced by the row that stays zero."""
    texts = np.zeros((2, BUCKETS + 1), dtype=np.int32)
    for a, b in zip(starts, ends, strict=True):
        own = rows[flat[a:b]]
        for k in (0, 1):
            texts[k, np.unique(own[:, k])] += 1
    out = rows.copy()
    for k in (0, 1):
        out[texts[k, rows[:, k]] < 2, k] = BUCKETS
    return out


def fit(texts: list[bytes | None], toxic: np.ndarray, calibrate: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on the rows that ``calibrate`` does not mark, then set the thresholds on those it does."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    table = np.zeros((BUCKETS + 1, DIM), np.float32)
    filters = [rng.normal(0, 0.3 / w**0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(table, filters, np.zeros(n_filters, np.float32), rng.normal(0, 0.3, n_filters).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)))
    words = Vocabulary(limit=1 << 62)
    flat, starts = words.texts(texts)
    ends = np.append(starts[1:], len(flat))
    rows = _shared(np.array(words.rows, dtype=np.int64).reshape(-1, 2), flat, starts, ends)
    used = np.unique(rows)
    table[used] = rng.normal(0, 0.1, (len(used), DIM))
    table[BUCKETS] = 0
    train = np.flatnonzero(~calibrate)
    share = max(1e-6, float(toxic[train].mean())) if len(train) else 0.5
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / max(1e-6, 1 - share))
    seen_table = np.full(BUCKETS + 1, 1e-6, np.float32)
    dense = [*filters, model.bias, model.out]
    first, second, step = [np.zeros_like(d) for d in dense], [np.zeros_like(d) for d in dense], 0
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(train))))
    for epoch in range(epochs):
        order = rng.permutation(train)
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            ids = np.concatenate([flat[starts[k] : ends[k]] for k in batch])
            begin = np.concatenate(([0], np.cumsum(ends[batch] - starts[batch])))
            two = rows[ids]
            x = table[two[:, 0]] + table[two[:, 1]]
            z = model.maps(x)
            z[_tails(begin[1:])] = -np.inf
            top = np.stack([z[a:b].argmax(axis=0) + a for a, b in zip(begin[:-1], begin[1:], strict=True)])
            pooled = np.take_along_axis(z, top, axis=0)
            live = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ model.out + model.out_bias, -30, 30)))
            g = ((p - toxic[batch]) * weight[batch] / len(batch)).astype(np.float32)
            g_out = live.T @ g + 1e-4 * model.out
            g_pool = (g[:, None] * model.out) * (pooled > 0)
            model.out_bias -= rate * float(g.sum())
            grads, moved_at, moved_by = [], [], []
            for k, (w, kernel) in enumerate(zip(WIDTHS, filters, strict=True)):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                g_kernel = np.zeros_like(kernel)
                for j in range(w):
                    place = np.minimum(top[:, own] + j, len(x) - 1)
                    g_kernel[j] = np.einsum("bf,bfd->df", g_pool[:, own], x[place])
                    moved_at.append(place.ravel())
                    moved_by.append((g_pool[:, own, None] * kernel[j].T[None]).reshape(-1, DIM))
                grads.append(g_kernel)
            step += 1
            for d, gr, m, v in zip(dense, [*grads, g_pool.sum(axis=0), g_out], first, second, strict=True):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                d -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            place, by = np.concatenate(moved_at), np.concatenate(moved_by)
            live_rows = np.abs(by).sum(axis=1) > 0
            touched = two[place[live_rows]].ravel()
            unique, inverse = np.unique(touched, return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, np.repeat(by[live_rows], 2, axis=0))
            seen_table[unique] += (total * total).mean(axis=1)
            table[unique] -= 4 * rate * total / np.sqrt(seen_table[unique])[:, None]
            table[BUCKETS] = 0
    _calibrate(model, words, texts, toxic, np.flatnonzero(calibrate))
    return model


def _calibrate(model: Model, words: Vocabulary, texts: list[bytes | None], toxic: np.ndarray, rows: np.ndarray, least: int = 12) -> None:
    """Per language, the threshold of fewest errors; a language with few toxic rows takes that of all rows."""
    own = [texts[k] for k in rows]
    scores = Scorer(model)(own)
    logit = np.log(np.clip(scores, 1e-12, 1)) - np.log(np.clip(1 - scores, 1e-12, 1))
    language = np.array([_language(words, t) for t in own], dtype=np.int64)

    def best(some: np.ndarray) -> float:
        order = np.argsort(logit[some])
        x, y = logit[some][order], toxic[rows][some][order]
        errors = np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
        cuts = np.flatnonzero(errors == errors.min())
        edges = np.concatenate(([x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]))
        return float(edges[cuts[len(cuts) // 2]])

    common = best(np.arange(len(rows))) if len(rows) else 0.0
    for k in range(len(LANGUAGES)):
        some = np.flatnonzero(language == k)
        model.thresholds[k] = best(some) if (toxic[rows][some] == 1).sum() >= least else common


def _language(words: Vocabulary, text: bytes | None) -> int:
    seen = np.bincount([words.language[words[w]] for w in (text or b"").split()] or [len(FUNCTION_WORDS)], minlength=len(LANGUAGES))[:-1]
    return int(seen.argmax()) if seen.max() > 0 else len(FUNCTION_WORDS)


def _unfit() -> Model:
    """Without rows of both classes every text scores below 0.5."""
    n = FILTERS * len(WIDTHS)
    return Model(np.zeros((BUCKETS + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), -2.0, np.zeros(len(LANGUAGES)))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxic, text): the bounded sample of labelled rows outside the held-out fold that training takes.

    Of either class the first ``TOXIC_ROWS`` or ``CLEAN_ROWS`` labelled ids in the order of a hash; of rows that
    repeat an id, the least text.  Rows without a label, or whose label is neither 0 nor 1, are not taken.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionAll(usable.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    chosen = chosen.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("long").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).cast("binary").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("text_id") == F.col("label_id"))
    return found.groupBy(F.col("label_id").cast("long").alias("id"), "toxic").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold, in the order of a hash of the id.

    At most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean rows, and of these no more than ``max_bytes`` of whole
    texts, are fit in one task; only the model reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, toxic, held = [], [], [], 0
        for batch in batches:
            for own, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                size = len(text.as_buffer())
                if held + size <= max_bytes:
                    ids.append(own)
                    texts.append(text.as_py())
                    toxic.append(label)
                    held += size
        order = sorted(range(len(ids)), key=ids.__getitem__)
        marks = np.array([toxic[k] for k in order], dtype=np.int64)
        if len(set(toxic)) < 2:
            return
        calibrate = np.array([xxhash.xxh64_intdigest(str(ids[k]), SEED) % 4 == 0 for k in order])
        yield pa.RecordBatch.from_arrays([pa.array([fit([texts[k] for k in order], marks, calibrate).packed()], pa.binary())], names=["model"])

    rows = sampled(docs, labels, id_col, text_col).repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    found = rows.select("id", "toxic", "text").mapInArrow(run, "model binary").collect()
    return Model.unpacked(bytes(found[0]["model"])) if found else _unfit()


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text; null and empty texts score as texts without words.

    The score is read off the text alone.  Repeated rows score alike; an empty table gives an empty result.
    ``score_col`` must not be a column of ``docs``.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(Model.unpacked(shipped.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text_col).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(texts), pa.float64())], schema=pa.schema([*part.schema, pa.field(score_col, pa.float64())]))

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(score_col)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a null id is not held out."""
    model = train(docs, labels, id_col, text_col)
    told = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return told.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
