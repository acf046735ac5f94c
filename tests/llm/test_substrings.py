import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bindery.llm import substrings, wordhash


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    starts = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = Counter()
    for doc, words in texts:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if starts[tuple(words[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[(doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    return out


def rows_of(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in df.collect())


@pytest.mark.parametrize(("window", "phrase", "hot"), [(35, 10, 2000), (35, 10, 1), (5, 3, 2), (3, 3, 2000), (1, 1, 5)])
def test_removal(docs, strange_rows, window, phrase, hot):
    assert rows_of(substrings.remove_repeats(docs, window=window, phrase=phrase, hot=hot)) == brute(strange_rows, window)


def test_periodic_texts(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 80)))) for k in range(40)]
    rows += [(100, "a " * 300), (101, "a b c " * 100), (102, " ".join(str(i) for i in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substrings.remove_repeats(df, window=7, phrase=3, hot=3)) == brute(rows, 7)


def test_spans(spark):
    df = spark.createDataFrame([(1, "x a b c y"), (2, "z a b c")], "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substrings.remove_repeats(df, window=3, phrase=2).collect()}
    assert found == {1: [(1, 4)], 2: [(1, 4)]}


def test_automaton_locates_what_no_text_named():
    """A passage read in one text is located in every other text of the shard, whatever was sent for those."""
    texts = [b"a b c d".split(), b"q a b c r a b c".split(), b"a b x".split()]
    covered = substrings.locate(texts, [(0, 0), (0, 1), (0, 2)], [(b"a b c".split(), (0, 0, 0))], window=3)
    assert [c.tolist() for c in covered] == [[False] * 4, [False, True, True, True, False, True, True, True], [False] * 3]
    covered = substrings.locate(texts, [(0, 0), (0, 1), (0, 2)], [(b"a b c".split(), (0, 0, 0)), (b"a b c".split(), (0, 1, 1))], window=3)
    assert covered[0].tolist() == [True, True, True, False] and covered[1].sum() == 6


def test_passage_is_covered_end_to_end():
    words = [str(k).encode() for k in range(20)]
    for n in range(3, 20):
        covered = substrings.locate([words], [(0, 0)], [(words[1 : 1 + n], (5, 5, 0))], window=3)
        assert covered[0].tolist() == [False, *[True] * min(n, 19), *[False] * max(0, 19 - n)]


def test_segments_name_another_place():
    file, row, start = np.array([1, 1, 2]), np.array([4, 5, 0]), np.array([0, 7, 3])
    hashes = np.array([10, 11, 12, 10, 11, 99, 10])
    found = substrings._segments(file, row, start, np.array([3, 3, 1]), hashes)
    assert [tuple(int(c[k]) for c in found) for k in range(len(found[0]))] == [(1, 4, 0, 1, 2, 0, 3), (1, 4, 1, 1, 1, 5, 8), (1, 5, 7, 2, 1, 4, 0), (2, 0, 3, 1, 1, 4, 0)]


@pytest.mark.parametrize("hot", [1, 2000])
def test_collisions_remove_nothing(spark, hot):
    """All windows that share a phrase have one hash here; none of them recurs."""
    rng = random.Random(2)
    phrase = [f"p{k}" for k in range(10)]
    rows = [(k, " ".join([*(f"w{rng.random()}" for _ in range(30)), *phrase, *(f"w{rng.random()}" for _ in range(30))])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_removed"] for r in substrings.remove_repeats(df, hot=hot, bits=1).collect()} == {0}


def test_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_words_are_hashed_without_a_lookup_each(monkeypatch):
    """Equal words have equal hashes, others not, wherever they lie; no word of the texts is looked up by itself."""
    monkeypatch.setattr(wordhash, "_hashes", None)
    rng = random.Random(4)
    words = ["".join(rng.choices("abé\0", k=rng.randint(1, 9))).encode() for _ in range(300)] + [b"q" * 65, b"z" * 300_000]
    texts = [None, b"", b" \t", b" one", *(b"".join(w + rng.choice([b" ", b"\n\x0b", b"\x0c\r"]) for w in rng.choices(words[:-1], k=300)) for _ in range(300))]
    texts += [b" ".join(rng.choices(words[:-1], k=90_000)), words[-1], b"one " + words[-1], None, b"one"]
    hashes: dict[bytes, int] = {}
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.binary()).slice(3, 40)):
        found = list(wordhash.text_hashes(column))
        assert [len(h) for h in found] == [len((t or b"").split()) for t in column.to_pylist()]
        for text, h in zip(column.to_pylist(), found, strict=True):
            assert all(hashes.setdefault(w, k) == k for w, k in zip((text or b"").split(), h.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes)
    docs = pa.array(texts[4:8], pa.binary())
    assert all(len(a) for _, a, _ in (substrings._windows(h, 35, 10) for h in wordhash.text_hashes(docs)))


def test_words_of_no_passage_get_no_letter(monkeypatch):
    named, miss = [], substrings._Letters.__missing__
    monkeypatch.setattr(substrings._Letters, "__missing__", lambda self, w: named.append(w) or miss(self, w))
    texts = [[b"x", b"a", b"b", b"c", b"y"], [b"z", b"a", b"b", b"c"], [b"\0"] * 9]
    found = substrings.locate(texts, [(0, 0), (0, 1), (0, 2)], [([b"a", b"b", b"c"], (0, 0, 1))], 3)
    assert [x.tolist() for x in found] == [[False] * 5, [False, True, True, True], [False] * 9]
    assert sorted(named) == [b"a", b"b", b"c"]
