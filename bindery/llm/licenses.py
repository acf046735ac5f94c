"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are lower-cased and stripped of marks; shingles have five words.  Templates of similar length share a
window size, a quarter longer than they are, and windows start every quarter of it, so that some window holds
all of a passage.  A window that contains a template to 0.8 has a Jaccard similarity of at least 0.44 with it;
32 bands of 2 hashes then collide with probability 0.998 or more.  A band can only collide where a window has a
template's shingle, so windows without one are passed over unhashed, and nothing is lost by it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm import license_texts
from bindery.llm.wordhash import CACHE, rolling

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 2
SEED = 5
_MARKS = b".,;:!?\"'()[]{}<>*#"


class _Plain(dict):
    """Lower-cased word -> the hash of it without the marks around it; nothing for marks alone."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        plain = word.strip(_MARKS)
        self[word] = h = xxhash.xxh64_digest(plain, SEED) if plain else b""
        return h


_plain = _Plain()


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of every five consecutive words, lower-cased and stripped; of the whole sequence if there are fewer."""
    h = np.frombuffer(b"".join(map(_plain.__getitem__, (text or b"").lower().split())), dtype=np.uint64)
    return rolling(h, min(SHINGLE, len(h)), 0xD6E8FEB86659FD93) if len(h) else h


def _signatures(groups: list[np.ndarray], mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """(groups, BANDS * ROWS) least hashes."""
    flat = np.concatenate(groups)
    starts = np.cumsum([0, *(len(g) for g in groups[:-1])])
    out = np.empty((len(groups), len(mult)), dtype=np.uint64)
    for k in range(len(mult)):
        h = (flat ^ add[k]) * mult[k]
        out[:, k] = np.minimum.reduceat(h ^ (h >> np.uint64(31)), starts)
    return out


class Scanner:
    """The templates by window size and band."""

    def __init__(self, templates: dict[str, list[str]], similarity: float = SIMILARITY) -> None:
        rng = np.random.default_rng(SEED)
        self.similarity = similarity
        self.mult = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.names, self.own, sizes = [], [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                h = shingles(text.encode())
                if len(h):
                    self.names.append(name)
                    self.own.append(np.unique(h))
                    sizes.append(len(h) + SHINGLE - 1)
        self.all = np.unique(np.concatenate(self.own)) if self.own else np.zeros(0, dtype=np.uint64)
        self.classes: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
        size = 0
        for k in order:
            if not size or sizes[k] < 0.8 * size:
                size = sizes[k]
                self.classes[size] = defaultdict(list)
            signature = _signatures([self.own[k]], self.mult, self.add)[0]
            for band in range(BANDS):
                self.classes[size][band, signature[band * ROWS : (band + 1) * ROWS].tobytes()].append(k)

    def matches(self, text: bytes | None) -> list[tuple[str, float, np.ndarray]]:
        """(license, containment, places of its shingles) of the best window per license, the best first."""
        h = shingles(text)
        hits = np.flatnonzero(np.isin(h, self.all))
        if not len(hits):
            return []
        best: dict[str, tuple[float, int, np.ndarray]] = {}
        for size, bands in self.classes.items():
            stride = max(1, size // 4)
            n = max(1, size + stride - SHINGLE + 1)
            starts = np.unique(np.concatenate([hits // stride - k for k in range(-(-n // stride) + 1)])) * stride
            starts = starts[starts >= 0]
            groups = [h[s : s + n] for s in starts.tolist()]
            signatures = _signatures(groups, self.mult, self.add)
            for s, group, signature in zip(starts.tolist(), groups, signatures, strict=True):
                found = {k for band in range(BANDS) for k in bands.get((band, signature[band * ROWS : (band + 1) * ROWS].tobytes()), ())}
                for k in found:
                    share = float(np.isin(self.own[k], group).mean())
                    rank = share, len(self.own[k])
                    if share >= self.similarity and rank > best.get(self.names[k], (0.0, 0, h))[:2]:
                        best[self.names[k]] = *rank, s + np.flatnonzero(np.isin(group, self.own[k]))
        return [(name, share, at) for name, (share, _, at) in sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))]

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """(license, containment, first word, word behind) of the licenses found.

        Texts of related licenses share most of their words.  A license is passed over if half of the shingles that
        speak for it speak for one that is contained more fully, or as fully and is longer.
        """
        out: list[tuple[str, float, int, int]] = []
        spoken: list[np.ndarray] = []
        for name, share, at in self.matches(text):
            if not any(2 * np.isin(at, other).sum() >= len(at) for other in spoken):
                spoken.append(at)
                out.append((name, share, int(at[0]), int(at[-1]) + SHINGLE))
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, start, end): one row per row of ``docs`` and license found in it.

    ``start`` and ``end`` are the words of the passage in its best window, the first of equals; words of marks alone
    do not count.  Of related licenses that the same passage resembles, the one contained most fully is told.  Null and empty texts have no
    license; a null id keeps its rows; repeated rows repeat theirs; other columns are ignored; an empty table
    gives an empty result.  Whole texts are scanned where they are read; the templates, which the caller holds
    in memory, are all that is sent out.
    """
    chosen = license_texts.templates() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in scanner.scan(text.as_py()):
                    for column, value in zip(out, (doc, *row), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "license", "containment", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, license string, containment double, start long, end long")
