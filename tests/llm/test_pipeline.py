import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bindery.llm.queries import tokenizer_path
from tests.conftest import DATA


def without_copies(rows):
    """Of rows (id, text, source ...) with equal texts, that of the smallest id."""
    low = {}
    for r in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        low[text] = min(low.get(text, r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in set(low.values())]


def without_near_copies(rows):
    """One of each group that pairs of five-word similarity 0.8 connect, by trying all pairs."""
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    low = {d: d for d in sets}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def mixed(rows):
    """(id, text) of the mix: sources to their targets in the order of a hash, the last in part."""
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows}
    members = defaultdict(list)
    for r in sorted(rows, key=lambda r: (int(hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()[:15], 16), r["doc_id"])):
        members[r["source"]].append(r)
    names = sorted((s for s in members if s is not None), key=lambda s: s.encode()) + [s for s in members if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(len(words[r["doc_id"]]) for r in members[s]) for s in names}
    total, capped = 1.5 * sum(size.values()), set()
    while free := [s for s in names if s not in capped]:
        level = (total - 2 * sum(size[s] for s in capped)) / sum(weight[s] for s in free)
        if not (over := {s for s in free if level * weight[s] > 2 * size[s]}):
            break
        capped |= over
    out = []
    for s in names:
        want = int(np.floor((2 * size[s] if s in capped else level * weight[s]) + 0.5))
        copies, rest = divmod(want, size[s]) if size[s] else (0, 0)
        for r in members[s]:
            own = words[r["doc_id"]]
            extra = min(len(own), rest)
            rest -= extra
            out += [(r["doc_id"], r["text"])] * (copies if own else 1)
            if extra:
                out.append((r["doc_id"], r["text"] if extra == len(own) else " ".join(own[:extra])))
    return out


def check_packing(pieces, docs, length=1024, end=0):
    """Each id lies in one piece with its checksum; sequences are gapless and full but for a few."""
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    whole = defaultdict(list)
    for doc, text in docs:
        whole[doc].append([*library.encode(text or "", add_special_tokens=False).ids, end])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    expected = Counter((d, len(ids)) for d, texts in whole.items() for ids in texts)
    starts = Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert starts == expected
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"], p["doc_tokens"]] += p["length"]
        assert any(len(ids) == p["doc_tokens"] and crc(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for ids in whole[p["doc_id"]])
    assert tokens == Counter({k: k[1] * n for k, n in expected.items()})
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in sequences.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= length
    assert len(sequences) <= 1 + -(-sum(len(i) for t in whole.values() for i in t) // length)


def test_run_equals_brute_force(spark):
    """Every stage on real documents against plain Python; what the model rejects is taken from the first stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-test-{k}"
        out = stage(spark, held, DATA)
        assert out.columns == docs.columns, name
        out.write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path)
        found = sorted((r["doc_id"], r["text"] or "") for r in held.collect())
        if k == 0:
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            clean = {r["doc_id"] for r in rows if labels.get(r["doc_id"]) == 0}
            stay = {d for d, _ in found}
            assert len(clean & stay) >= 0.95 * len(clean)
            rows = [r for r in rows if r["doc_id"] in stay]
            assert len(rows) == len(found)
        else:
            rows = [without_copies, without_near_copies, lambda r: [{"doc_id": d, "text": t} for d, t in mixed(r)]][k - 1](rows)
            assert sorted((r["doc_id"], r["text"] or "") for r in rows) == found, name
    check_packing([r.asDict() for r in corpus_pipeline.run(spark, DATA).collect()], [(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("kind", ["stored", "empty"])
def test_strange_rows(spark, request, kind):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.count() <= 3 * docs.count()
    assert corpus_pipeline.pack(spark, docs, DATA).count() >= docs.count()
