import math

import numpy as np

from bindery.llm import neighbours


def brute(vectors, threshold=0.95):
    usable = [v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    x = np.array([v if u else [1.0] * 16 for (_, v), u in zip(vectors, usable, strict=True)], dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & np.array(usable)[:, None] & np.array(usable)[None]
    np.fill_diagonal(near, False)
    root = list(range(len(vectors)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    groups = [find(k) for k in range(len(vectors))]
    return near.sum(axis=1).tolist(), groups


def made(seed=1, n=500):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=16) for _ in range(n)]
    for k in range(0, 120, 3):
        rows.append(rows[k] + rng.normal(scale=0.04, size=16))
    hub = rng.normal(size=16)
    rows += [hub + rng.normal(scale=0.05, size=16) for _ in range(150)]
    rows += [rows[5]] * 40 + [rows[7] * 2.5]
    return [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(rows)]


ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [None] + [1.0] * 15), (9007, [1.0, 2.0]), (9008, [1e-38] + [0.0] * 15), (9009, [3e38] * 16)]


def run(spark, rows, **settings):
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows], "vec_id long, embedding array<float>, digest string, node string")
    return neighbours.near_duplicates(df, **settings).collect()


def test_links_and_components(spark):
    rows = made() + ODD
    links, groups = brute(rows)
    low = {}
    for (vec, _), g in zip(rows, groups, strict=True):
        low[g] = min(low.get(g, vec), vec)
    found = {r["vec_id"]: r for r in run(spark, rows)}
    told = [found[vec]["n_links"] for vec, _ in rows]
    assert all(t <= n for t, n in zip(told, links, strict=True))
    assert sum(told) >= 0.99 * sum(links)
    same = [found[vec]["component_id"] == low[g] for (vec, _), g in zip(rows, groups, strict=True)]
    assert sum(same) >= 0.99 * len(same)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_saturated_component_spreads_over_blocks(spark, monkeypatch):
    """All links of a group far larger than a list or a block are counted."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(3)
    hub = rng.normal(size=16)
    rows = [(k, (hub + rng.normal(scale=0.02, size=16)).tolist()) for k in range(300)]
    assert [r["n_links"] for r in run(spark, rows)] == [299] * 300


def clusters(seed=5, groups=8, copies=60):
    """Groups of close copies in a row, each linked with the next only; more copies than the longest lists hold."""
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    centres = [np.cos(0.26 * g) * u + np.sin(0.26 * g) * v for g in range(groups)]
    rows = [c + rng.normal(scale=0.002, size=16) for c in centres for _ in range(copies)] + list(rng.normal(size=(400, 16)))
    return [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(rows)]


def test_links_between_groups_of_close_copies(spark):
    """Lists that copies fill do not hide the links to the next group."""
    rows = clusters()
    links, groups = brute(rows)
    assert groups[:480] == [0] * 480 and links[0] == 119
    found = {r["vec_id"]: r for r in run(spark, rows)}
    assert [found[k]["n_links"] for k in range(480)] == links[:480]
    assert [found[k]["component_id"] for k in range(480)] == [0] * 480


def test_all_pairs_where_the_audit_fails(spark, monkeypatch):
    """Without usable lists, the result is still whole."""
    monkeypatch.setattr(neighbours, "GROWTHS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "_audit", lambda *_: 0.0)
    rows = clusters(groups=3, copies=20)
    links, groups = brute(rows)
    found = {r["vec_id"]: r for r in run(spark, rows, trees=1, rounds=0)}
    assert [found[k]["n_links"] for k, _ in rows] == links and [found[k]["component_id"] for k, _ in rows] == groups


def test_repeated_rows_and_null_ids(spark):
    v = [1.0] * 16
    found = run(spark, [(5, v), (5, v), (None, v), (7, [-x for x in v])])
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in found) == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]


def test_each_length_is_searched(spark):
    """Vectors link within their length, whichever is the commonest; one that is alone links with its copies."""
    rng = np.random.default_rng(4)
    hub = rng.normal(size=8)
    rows = made(n=120) + [(2000 + k, (hub + rng.normal(scale=0.01, size=8)).tolist()) for k in range(12)] + [(3000, [1.0, 2.0, 3.0]), (3001, [1.0, 2.0, 3.0]), (3002, [5.0])]
    found = {r["vec_id"]: r for r in run(spark, rows)}
    links, _ = brute(rows[:-15])
    assert [found[k]["n_links"] for k, _ in rows[:-15]] == links
    assert [found[2000 + k]["n_links"] for k in range(12)] == [11] * 12 and {found[2000 + k]["component_id"] for k in range(12)} == {2000}
    assert [(found[k]["n_links"], found[k]["component_id"]) for k in (3000, 3001, 3002)] == [(1, 3000), (1, 3000), (0, 3002)]


def test_nodes_that_share_a_hash_are_told_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "c", 12), (1, "d", 13)], "node long, digest string, low long")
    found = {r["digest"]: r["node"] for r in neighbours._apart(df, f"file://{tmp_path}").collect()}
    assert len(set(found.values())) == 4 and found["a"] == 1 and found["c"] == 2


def test_empty(spark):
    assert run(spark, []) == []
    assert [r["n_links"] for r in run(spark, ODD[:3])] == [0, 0, 0]
