import random

import pytest
import xxhash
from pyspark.sql import functions as F

from bindery.llm import simhash
from bindery.llm.components import components
from bindery.llm.common import shared_dir


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints(strange_rows):
    for row in strange_rows:
        told = simhash.fingerprint(None if row[1] is None else row[1].encode())
        assert told % (1 << 64) == brute_fingerprint(row[1])


def test_jvm_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_lose_none(spark):
    rng = random.Random(1)
    bases = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = set(bases)
    for b in bases:
        for _ in range(12):
            flipped = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                flipped ^= 1 << bit
            fps.add(flipped)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    expected = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {(min(r), max(r)) for r in map(tuple, simhash.links(df).collect())} == {(min(p), max(p)) for p in expected}
    assert simhash.anchored(df).groupBy("fp").count().agg(F.max("count")).first()[0] <= 32


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    expected = brute_components(pairs, nodes)
    found = components(spark.createDataFrame(pairs, "a long, b long"), shared_dir(spark, "test"))
    assert {r["node"]: r["root"] for r in found.collect()} == expected


def expected_groups(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(fps))
    pairs = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    root = brute_components(pairs, distinct)
    low = {}
    for f, r in zip(fps, rows, strict=True):
        if r[0] is not None:
            low[root[f]] = min(low.get(root[f], r[0]), r[0])
    return [(r[0], f, low.get(root[f])) for f, r in zip(fps, rows, strict=True)]


@pytest.mark.parametrize("kind", ["docs", "stored"])
def test_near_duplicates(request, strange_rows, kind):
    found = simhash.near_duplicates(request.getfixturevalue(kind)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or -1)
    assert sorted([(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in found], key=key) == sorted(expected_groups(strange_rows), key=key)
    assert sum(r["kept"] for r in found) == len({(c, f if c is None else 0) for _, f, c in expected_groups(strange_rows)})


def test_deduplicated_keeps_columns(docs):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_duplicates(docs).where("kept").count()


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
