import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bindery.llm import packing, tokenfiles
from bindery.llm.encoding import Encoder, encoder
from bindery.llm.queries import tokenizer_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", " a", "a ", "a  b", "a\n\nb", "a\tb", "it's", "don't stop", "İstanbul ΣΑΣ ΟΔΟΣ", "áb c", "ﬁne x²", "hello, world!!", "<|endoftext|> x", "x\xa0y z", "I'll 'tis", "日本 語", "a\x1cb", "foo...", "Ǆ ǅ", "123 4,5", "ſs K", "\n", "É È", "ß ẞ"]


def library(name):
    told = Tokenizer.from_file(tokenizer_path(name))
    told.encode_special_tokens = True
    return told


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(name, strange_rows):
    rng = random.Random(4)
    alphabet = list("ab é'́ .,\n S9²ſΣ!<|>_\t\xa0Iİ")
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(3000)] + [r[1] or "" for r in strange_rows]
    own, told = Encoder(tokenizer_path(name), cache=50), library(name)
    for text in texts:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == told.encode(text, add_special_tokens=False).ids, text[:50]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=40), max_size=12), st.integers(0, 5), st.integers(2, 4))
def test_grammar_round_trip(documents, rounds, least):
    docs = [np.array(d, dtype=np.uint16) for d in documents]
    shard = tokenfiles.Shard(tokenfiles.write_shard(docs, 7, rounds, least))
    assert [d.tolist() for d in shard.documents()] == documents
    for k, d in enumerate(documents):
        assert shard.document(k).tolist() == d
        for a in range(0, len(d), 7):
            assert shard.span(k, a, min(len(d), a + 5)).tolist() == d[a : a + 5]


def test_grammar_compresses():
    rng = random.Random(1)
    words = [[rng.randrange(1000) for _ in range(4)] for _ in range(50)]
    docs = [np.array([t for w in rng.choices(words, k=400) for t in w], dtype=np.uint16) for _ in range(20)]
    assert len(tokenfiles.write_shard(docs, 1000)) < 0.6 * 2 * sum(map(len, docs))


@pytest.mark.parametrize("case", ["copies", "runs", "many pairs"])
def test_no_frequent_pair_is_left(case):
    """Rounds go on until no pair has the uses that a rule needs, whatever number of rules that takes."""
    rng = np.random.default_rng(1)
    if case == "copies":
        docs, terminals = [rng.integers(0, 1000, 500).astype(np.uint16)] * 1000, 1000
    elif case == "runs":
        docs, terminals = [np.full(n, 5, dtype=np.uint16) for n in range(1, 400)], 6
    else:
        docs, terminals = [rng.permutation(np.repeat(np.arange(30_000, dtype=np.uint16), 2))] * 16, 49_000
    last = np.zeros(sum(map(len, docs)), dtype=bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, ends, rules = tokenfiles.compress(np.concatenate(docs), last, terminals)
    keys = (symbols[:-1].astype(np.int64) << 32 | symbols[1:])[~ends[:-1]]
    used = np.unique(keys[keys >> 32 != keys & 0xFFFFFFFF], return_counts=True)[1]
    assert used.max(initial=0) < tokenfiles.LEAST
    if case == "copies":
        assert len(symbols) == 1000
    shard = tokenfiles.Shard(tokenfiles.write_shard(docs, terminals))
    assert all((a == b).all() for a, b in zip(shard.documents(), docs, strict=True))


@pytest.mark.parametrize("shard_ids", [1 << 20, 100])
def test_token_files(spark, docs, strange_rows, tmp_path, shard_ids):
    path = f"file://{tmp_path}/shards"
    tokenfiles.write_tokens(docs, path, tokenizer_path(FILES[1]), shard_ids=shard_ids)
    told, start, expected = library(FILES[1]), 0, []
    for row in sorted(strange_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*told.encode(row[1] or "", add_special_tokens=False).ids, 2]
        expected.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = [tuple(r) for r in tokenfiles.read_tokens(spark, path).orderBy("start").collect()]
    assert found == expected


def test_token_files_of_nothing(spark, empty, tmp_path):
    tokenfiles.write_tokens(empty, f"file://{tmp_path}/shards", tokenizer_path(FILES[1]))
    assert tokenfiles.read_tokens(spark, f"file://{tmp_path}/shards").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30))
def test_plan(sizes):
    pieces = packing.plan(sizes, 8)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, took, sequence, offset in pieces:
        assert took > 0
        by_doc[doc].append((start, took))
        by_sequence[sequence].append((offset, took))
    for doc, size in enumerate(sizes):
        at = 0
        for start, took in sorted(by_doc[doc]):
            assert start == at
            at += took
        assert at == size
    for held in by_sequence.values():
        at = 0
        for offset, took in sorted(held):
            assert offset == at
            at += took
        assert at <= 8
    assert len(by_sequence) == sum(s // 8 for s in sizes) + -(-sum(s % 8 for s in sizes) // 8)


def test_plan_balances_cost():
    """Many documents of many sizes: full sequences differ little in attention cost."""
    rng = random.Random(2)
    spent = defaultdict(float)
    for _, _, took, sequence, _ in packing.plan([rng.randint(20, 600) for _ in range(400)]):
        spent[sequence] += packing.cost(took)
    full = sorted(spent.values())[1:]
    assert full[-1] - full[0] < 0.06 * full[-1]


def test_packed(docs, strange_rows):
    told = library(FILES[0])
    expected = defaultdict(list)
    for row in strange_rows:
        expected[row[0]].append([*told.encode(row[1] or "", add_special_tokens=False).ids, 0])
    pieces = packing.packed(docs, tokenizer_path(FILES[0]), shard_bytes=100_000).collect()
    sequences, held = defaultdict(list), defaultdict(int)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        held[p["doc_id"]] += p["length"]
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for ids in expected[p["doc_id"]])
    assert dict(held) == {k: sum(map(len, v)) for k, v in expected.items()}
    for own in sequences.values():
        at = 0
        for offset, took in sorted(own):
            assert offset == at
            at += took
        assert at <= 1024


def test_packed_nothing(empty):
    assert packing.packed(empty, tokenizer_path(FILES[0])).count() == 0


def test_worker_keeps_one_encoder():
    assert encoder(tokenizer_path(FILES[0])) is encoder(tokenizer_path(FILES[0]))


def test_rules_expand_by_levels():
    """As many steps as rules are deep, and each rule only after its parts."""
    rng = np.random.default_rng(4)
    documents = [rng.choice(40, 3000, p=np.arange(40, 0, -1) / 820).astype(np.uint32) for _ in range(20)] + [np.full(5000, 7, dtype=np.uint32)]
    shard = tokenfiles.Shard(tokenfiles.write_shard(documents, 64))
    levels = list(tokenfiles._levels(shard.left, shard.right, shard.terminals))
    assert [k for s, e in levels for k in range(s, e)] == list(range(len(shard.left))) and len(levels) < len(shard.left) / 4
    assert all(max(shard.left[s:e].max(), shard.right[s:e].max()) < shard.terminals + s for s, e in levels)
    assert all((a == b).all() for a, b in zip(shard.documents(), documents, strict=True))


def test_pieces_in_use_are_not_forgotten_with_others(monkeypatch):
    own, anew = Encoder(tokenizer_path(FILES[0]), cache=40), []
    word = own.word
    monkeypatch.setattr(own, "word", lambda w, lead: anew.append(w) or word(w, lead))
    for k in range(400):
        own.encode(f"{''.join(chr(97 + int(c)) for c in str(k))} always")
        assert all(len(p) + len(p.older) <= 40 for p in (own.first, own.spaced))
    assert anew.count("always") == 1


@pytest.mark.parametrize("name", FILES)
def test_uneven_texts_are_told_by_their_pieces(name, monkeypatch):
    """Uneven texts go to the library whole, and no text is searched for two marks of white space in a row."""
    own, told, whole = Encoder(tokenizer_path(name)), library(name), []
    library_takes = own.whole
    monkeypatch.setattr(own, "whole", lambda text: whole.append(text) or library_takes(text))
    uneven = [" ", "\n", " a", "a\n", "a  b", "a \nb", "a\n b", "a\n\nb", "a\tb", "É  é"]
    for text in [*uneven, "a b\nc.", "É é", *uneven]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == told.encode(text, add_special_tokens=False).ids
    assert whole == uneven * 2
