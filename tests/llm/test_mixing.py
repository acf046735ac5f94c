from collections import defaultdict

from bindery.llm import mixing
from tests.oracle import connect, same


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()) * 1.5, set()
    while len(capped) < len(names):
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}


def test_mix(docs, strange_rows):
    sizes = defaultdict(int)
    for r in strange_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    expected = brute_targets(sizes)
    found = mixing.mix(docs).collect()
    assert len(found) == len(strange_rows)
    taken = defaultdict(int)
    for r in found:
        assert abs(r["target"] - expected[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert sum(r["taken"] for r in found) == sum(taken.values())


def test_reruns_agree(spark, stored):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mixing.mix(stored)) == rows(mixing.mix(spark.read.parquet(*stored.inputFiles())))


def test_bins_do_not_change_the_mix(stored, monkeypatch):
    whole = sorted((r["id"] or -1, r["taken"]) for r in mixing.mix(stored).collect())
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    assert sorted((r["id"] or -1, r["taken"]) for r in mixing.mix(stored).collect()) == whole


def test_repeated_ids_do_not_make_a_bin(spark, tmp_path, monkeypatch):
    """Rows without an id, and of one id, are taken like others: to the target, and the same in each run."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 10)
    rows = [(None, "a b c", "x")] * 400 + [(7, "a b", "x")] * 300 + [(k, "a b c d", "x") for k in range(1000, 1200)] + [(k, "a " * 50, "y") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(path := f"file://{tmp_path}/docs")
    found = mixing.mix(spark.read.parquet(path)).collect()
    sizes = {"x": 2600, "y": 2000}
    expected = brute_targets(sizes)
    assert len(found) == len(rows)
    for s in sizes:
        assert abs(sum(r["taken"] for r in found if r["source"] == s) - expected[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(spark.read.parquet(path)).collect()))


def test_oracle(spark, tmp_path):
    from tests.conftest import DATA

    df = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).select("id", "size", "source_size", "target", "taken").withColumnRenamed("id", "doc_id")
    same(df, connect(DATA), mixing.ORACLE)


def test_mixed_repeats_documents(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = mixing.mix(docs).collect()
    words = sum(len((r["text"] or "").encode().split()) for r in out.select("text").collect())
    assert words == sum(r["taken"] for r in plan)


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
