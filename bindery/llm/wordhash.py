"""Hashes of words and of runs of consecutive words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hashes a worker holds.
CACHE = 400_000
_U = np.uint64


class _Hashes(dict):
    """Word -> 8 bytes of hash, for as many words as a worker may hold."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_digest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_hashes.__getitem__, words)), dtype=_U)


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hashes of every k consecutive values, modulo 2**64, by doubling."""
    power, parts, size = {1: _U(base)}, {1: h}, 1
    while 2 * size <= k:
        half = parts[size]
        parts[2 * size] = half[: len(half) - size] * power[size] + half[size:]
        power[2 * size] = _U(int(power[size]) ** 2 % (1 << 64))
        size *= 2
    out, done = parts[size], size
    while done < k:
        step = 1 << ((k - done).bit_length() - 1)
        n = len(h) - done - step + 1
        out = out[:n] * power[step] + parts[step][done : done + n]
        done += step
    return out


#: Bytes of texts that are hashed at once, and the longest words whose letters are summed; xxHash takes longer ones.
SPAN, LONG = 1 << 18, 64
_BASE = 0x9E3779B97F4A7C15
_blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_letters = np.where(_blank, _U(0), np.random.default_rng(71).integers(1, 1 << 64, 256, dtype=_U))
_powers, _inverses = (np.cumprod(np.append(_U(1), np.full(SPAN - 1, b, dtype=_U))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def words_in(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of the words of texts that lie end to end in ``SPAN`` bytes at most, cut at ``bounds`` too.

    A word's hash is a sum of its letters times powers of their places.
    """
    open_, shut = ~_blank[flat], np.ones(len(flat) + 1, dtype=bool)
    shut[:-1] = ~open_
    cut = np.zeros(len(flat) + 1, dtype=bool)
    cut[bounds] = True
    before = np.append(True, shut[:-1])[: len(flat)]
    begins = np.flatnonzero(open_ & (before | cut[:-1]))
    ends = np.flatnonzero(open_ & (shut[1:] | cut[1:])) + 1
    if not len(begins):
        return np.zeros(0, dtype=_U), begins, ends
    h = np.add.reduceat(_letters[flat] * _powers[: len(flat)], begins) * _inverses[begins]
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    for k in np.flatnonzero(ends - begins > LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(flat[begins[k] : ends[k]].tobytes())
    return h, begins, ends


def _long_text(text: bytes) -> np.ndarray:
    """The hashes of the words of a text beyond ``SPAN`` bytes, as ``words_in`` has them."""
    words, out, step = text.split(), [np.zeros(0, dtype=_U)], SPAN // (LONG + 1)
    for at in range(0, len(words), step):
        some = words[at : at + step]
        flat = np.frombuffer(b" ".join([w if len(w) <= LONG else b"-" for w in some]), dtype=np.uint8)
        h, _, _ = words_in(flat, np.zeros(1, dtype=np.int64))
        for k, w in enumerate(some):
            if len(w) > LONG:
                h[k] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.concatenate(out)


def text_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text (binary), in order; null texts have none."""
    texts = texts.fill_null(b"") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SPAN, "right")) - 1
        if last <= first:
            yield _long_text(flat[offsets[first] : offsets[first + 1]].tobytes())
            first += 1
            continue
        bounds = offsets[first : last + 1] - offsets[first]
        h, begins, _ = words_in(flat[offsets[first] : offsets[last]], bounds)
        yield from np.split(h, np.searchsorted(begins, bounds[1:-1]))
        first = last
