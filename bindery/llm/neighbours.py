"""Embedding near-duplicates by NN-descent.

Equal vectors are one node.  A first neighbour graph comes from leaves of random-projection trees.  NN-descent
refines it: per node, its neighbours and those it neighbours are compared with each other, and each keeps its
nearest.  Lists that are full of threshold edges are saturated: a link that both its lists miss joins two such
nodes.  They are searched again for their nearest outside their own component, which joins components, until no
list is full of threshold edges.  All links within components are then counted in blocks.  A brute-force audit
on sampled queries measures the share of vectors that have all their links, and lists and trees grow until it
suffices; if it never does, all pairs are compared.  Edges below the threshold are dropped, in double precision.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import delete, free_shuffles, keyed, shared_dir, written
from bindery.llm.components import components
from bindery.operators.skew import join_aggregated

logger = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Neighbours to a list; vectors to a leaf and to a block; trees; rounds; share of lists that may still change.
K, LEAF, BLOCK, TREES, ROUNDS, STILL = 8, 128, 512, 4, 4, 0.002
AUDIT, RECALL, GROWTHS = 256, 0.98, 3
SEED = 11
#: Groups that are compared together, so that small ones share the cost of a call.
_TOGETHER = 256


def _usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square overflows or vanishes."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _planes(tree: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, tree)).normal(size=(64, dim))[:bits]


def _leaves(nodes: DataFrame, n: int, trees: range, leaf: int) -> DataFrame:
    """(tree, code, cut, node, vector): each vector's leaf in each tree.

    A leaf is a cell of random hyperplanes.  Cells that hold more than ``leaf`` vectors are dealt to cuts of
    about that size, by hash, so no cell makes a task large.
    """
    bits = max(0, (max(1, n) // leaf)).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for tree in trees:
                code = ((x @ _planes(tree, bits, x.shape[1]).T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree)), pa.array(code.astype(np.int64)), batch.column(0), batch.column(1)], names=["tree", "code", "node", "vector"])

    coded = nodes.mapInArrow(run, f"tree long, code long, node long, vector {nodes.schema['vector'].dataType.simpleString()}")
    sizes = coded.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("size"))
    return join_aggregated(coded, sizes, ["tree", "code"]).select("tree", "code", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / leaf)).alias("cut"), "node", "vector")


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of each a among the rows, once each."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=bool)
    a, b, sim = a[fresh], b[fresh], sim[fresh]
    begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    near = rank < k
    return pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near]), pa.array(sim[near])], names=["a", "b", "sim"])


def _compare(groups: DataFrame, key: list[str], k: int, apart: str = "node") -> DataFrame:
    """(a, b, sim): within each group of (key, node, vector), each node's k nearest; groups are dealt by key.

    Rows that agree in the column ``apart`` are not compared.
    """

    def pairs(nodes: np.ndarray, kinds: np.ndarray, x: np.ndarray, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        parts = []
        for s, e in bounds:
            m = e - s
            if m < 2:
                continue
            sims = x[s:e] @ x[s:e].T
            own, kind = nodes[s:e], kinds[s:e]
            sims[kind[:, None] == kind[None]] = -2
            top = np.argpartition(-sims, min(k, m - 1) - 1, axis=1)[:, : min(k, m - 1)]
            values = np.take_along_axis(sims, top, axis=1).ravel()
            real = values > -2
            parts.append((np.repeat(own, top.shape[1])[real], own[top].ravel()[real], values[real]))
        if not parts:
            return _best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), k)
        return _best(*(np.concatenate(p) for p in zip(*parts, strict=True)), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            edges = _edges(table, key)
            if len(edges) > _TOGETHER:
                done = table.slice(0, edges[-1])
                yield pairs(done.column("node").to_numpy(), done.column(apart).to_numpy(), _matrix(done.column("vector").combine_chunks()), list(zip([0, *edges[:-1]], edges, strict=True)))
                table = table.slice(edges[-1])
            held = table
        if held is not None and held.num_rows:
            bounds = [0, *_edges(held, key), held.num_rows]
            yield pairs(held.column("node").to_numpy(), held.column(apart).to_numpy(), _matrix(held.column("vector").combine_chunks()), list(zip(bounds[:-1], bounds[1:], strict=True)))

    return groups.repartition(*map(F.col, key)).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, sim double")


def _edges(table: pa.Table, key: list[str]) -> list[int]:
    """Where a new group begins, but for the first."""
    changed = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for name in key:
        c = table.column(name).to_numpy()
        changed |= c[1:] != c[:-1]
    return (np.flatnonzero(changed) + 1).tolist()


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """(a, b, sim): the k nearest of each a, from rows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            edges = _edges(table, ["a"])
            if edges:
                done = table.slice(0, edges[-1])
                yield _best(*(done.column(c).to_numpy() for c in ("a", "b", "sim")), k)
                table = table.slice(edges[-1])
            held = pa.Table.from_batches([_best(*(table.column(c).to_numpy() for c in ("a", "b", "sim")), k)])
        if held is not None and held.num_rows:
            yield _best(*(held.column(c).to_numpy() for c in ("a", "b", "sim")), k)

    return rows.repartition(F.col("a")).sortWithinPartitions("a").mapInArrow(run, "a long, b long, sim double")


def _around(graph: DataFrame, k: int) -> DataFrame:
    """(centre, node): around each node itself, its list and up to 2k nearest of those that list it.

    The reverse lists are cut only as candidates of a round; whatever a cut leaves out is met through the
    forward lists, through later rounds, and in saturated components by the comparison in blocks.
    """
    reverse = _nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), 2 * k)
    return graph.select(F.col("a").alias("centre"), F.col("b").alias("node")).unionAll(reverse.select(F.col("a").alias("centre"), F.col("b").alias("node"))).unionAll(graph.select(F.col("a").alias("centre"), F.col("a").alias("node"))).distinct()


def _join_round(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours are compared with each other."""
    return _compare(_around(graph, k).join(nodes, "node").select("centre", "node", "vector"), ["centre"], k)


def _descend(graph: DataFrame, nodes: DataFrame, n: int, k: int, rounds: int, folder: str, name: str) -> DataFrame:
    """The graph after rounds of NN-descent, until fewer than ``STILL`` of its edges are new."""
    before = None
    for r in range(rounds):
        graph = written(_nearest(graph.unionAll(_join_round(graph, nodes, k)), k), folder, f"{name}-{r}")
        if r:
            delete(nodes.sparkSession, f"{folder}/{name}-{r - 1}")
        free_shuffles(nodes.sparkSession)
        total = graph.agg(F.sum("sim")).first()[0] or 0.0
        if before is not None and total - before < STILL * n * k * 0.01:
            break
        before = total
    return graph


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix ``near`` connects, one less than members of each group."""
    left, edges = np.ones(len(near), dtype=bool), []
    for s in range(len(near)):
        stack = [s] if left[s] else []
        left[s] = False
        while stack:
            u = stack.pop()
            fresh = np.flatnonzero(near[u] & left)
            left[fresh] = False
            edges += [(u, v) for v in fresh.tolist()]
            stack += fresh.tolist()
    return edges


def _all_edges(nodes: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(a, b): edges that connect all that links connect, from all pairs of blocks."""
    cuts = -(-n // block)
    dealt = nodes.select("node", "vector", F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(cuts)).cast("int").alias("cut"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    pair = both.select(F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "node", "vector")

    def edges(table: pa.Table) -> pa.RecordBatch:
        own, x = table.column("node").to_numpy(), _matrix(table.column("vector").combine_chunks())
        found = np.array(_forest(x @ x.T >= threshold), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(own[found[:, 0]]), pa.array(own[found[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bounds = [0, *_edges(table, ["i", "j"])]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                yield edges(table.slice(s, e - s))
            held = table.slice(bounds[-1])
        if held is not None and held.num_rows:
            bounds = [0, *_edges(held, ["i", "j"]), held.num_rows]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                yield edges(held.slice(s, e - s))

    return pair.repartition(F.col("i"), F.col("j")).sortWithinPartitions("i", "j").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, n_links): links within each component of (root, size, node, weight, vector), counted in pairs of blocks.

    A component is dealt to blocks by hash; each pair of blocks is one group, so a component of any size spreads
    over tasks, and only counts leave them.
    """
    cuts = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumn("cuts", cuts).withColumn("cut", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("cuts")).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pair = both.select("root", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "cut", "node", "weight", "vector")

    def count(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        nodes, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        side = table.column("cut").to_numpy() == table.column("i").to_numpy()
        x, out = _matrix(table.column("vector").combine_chunks()), np.zeros(table.num_rows, dtype=np.int64)
        diagonal = table.column("i").to_numpy() == table.column("j").to_numpy()
        for s, e in bounds:
            if diagonal[s]:
                near = x[s:e] @ x[s:e].T >= threshold
                near[np.arange(e - s), np.arange(e - s)] = False
                out[s:e] = near @ weight[s:e]
            else:
                left, right = s + np.flatnonzero(side[s:e]), s + np.flatnonzero(~side[s:e])
                near = x[left] @ x[right].T >= threshold
                out[left], out[right] = near @ weight[right], weight[left] @ near
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(out)], names=["node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            edges = _edges(table, ["root", "i", "j"])
            if edges:
                yield count(table.slice(0, edges[-1]), list(zip([0, *edges[:-1]], edges, strict=True)))
                table = table.slice(edges[-1])
            held = table
        if held is not None and held.num_rows:
            bounds = [0, *_edges(held, ["root", "i", "j"]), held.num_rows]
            yield count(held, list(zip(bounds[:-1], bounds[1:], strict=True)))

    counted = pair.repartition(F.col("root"), F.col("i"), F.col("j")).sortWithinPartitions("root", "i", "j").mapInArrow(run, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n_links"))


def _saturated(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node): whose list holds k threshold edges, so that there may be more."""
    return lists.where(F.col("sim") >= threshold).groupBy(F.col("a").alias("node")).count().where(F.col("count") >= k).select("node")


def _joined(graph: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float, k: int, trees: int, rounds: int, folder: str, name: str) -> DataFrame:
    """(node, root) after saturated nodes were searched for their nearest in other components.

    Their lists leave their own component out, so copies cannot fill them.  Whatever components a full list
    reaches become one with its own, so the next search looks beyond them; it ends when no list is full.
    Neighbours of neighbours are met through the first graph too.
    """
    left = written(_saturated(graph, threshold, k), folder, f"{name}-left")
    turn = 0
    while n := left.count():
        at, turn = f"{name}-{turn}", turn + 1
        own = written(left.join(nodes, "node").join(roots, "node").select("node", "root", "vector"), folder, f"{at}-nodes")
        leaves = _leaves(own.select("node", "vector"), n, range(trees), LEAF).join(own.select("node", "root"), "node")
        lists = written(_nearest(_compare(leaves, ["tree", "code", "cut"], k, "root"), k), folder, f"{at}-start")
        inside = graph.join(left, graph.a == left.node, "left_semi").join(left, graph.b == left.node, "left_semi")
        before = None
        for r in range(rounds):
            near = _around(lists.unionAll(inside), k).join(own, "node").select("centre", "node", "root", "vector")
            lists = written(_nearest(lists.unionAll(_compare(near, ["centre"], k, "root")), k), folder, f"{at}-{r}")
            free_shuffles(nodes.sparkSession)
            total = lists.agg(F.sum("sim")).first()[0] or 0.0
            if before is not None and total - before < STILL * n * k * 0.01:
                break
            before = total
        found = lists.where(F.col("sim") >= threshold).select("a", "b")
        if found.isEmpty():
            break
        tree = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(tree.unionAll(found), folder, f"{at}-components"), folder, f"{at}-roots")
        left = written(_saturated(lists, threshold, k), folder, f"{at}-left")
    return roots


def _audit(nodes: DataFrame, roots: DataFrame, links: DataFrame, threshold: float, queries: int) -> float:
    """The share of sampled vectors with links that have all of them; each is compared with all nodes, in blocks.

    The lower share of two samples of ``queries``: of all nodes, and of one node of each component, in which a
    large group counts no more than a small one.
    """
    mark = F.struct(F.xxhash64("node", F.lit(SEED)).alias("mark"), "node")
    named = nodes.join(roots, "node", "left").select("node", "vector", mark.alias("mark"), F.coalesce("root", "node").alias("root"))
    chosen = named.groupBy("root").agg(F.min("mark").alias("mark")).orderBy("mark").limit(queries).select("mark.node")
    groups = {r["node"] for r in chosen.collect()}
    everywhere = {r["node"] for r in nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(queries).select("node").collect()}
    found = nodes.where(F.col("node").isin(sorted(groups | everywhere))).select("node", "vector").collect()
    if not found:
        return 1.0
    ids = np.array([r["node"] for r in found])
    x = _matrix(pa.array([r["vector"] for r in found], pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                near = x @ _matrix(batch.column(2)).T >= threshold
                near &= ids[:, None] != batch.column(0).to_numpy()[None]
                total += near @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "n"])

    truth = nodes.select("node", "weight", "vector").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    told = truth.where("n > 0").join(links, "node", "left").select("node", (F.coalesce("n_links", F.lit(0)) >= F.col("n")).alias("whole")).collect()
    shares = [[r["whole"] for r in told if r["node"] in sample] for sample in (groups, everywhere)]
    return min(sum(x) / len(x) if x else 1.0 for x in shares)


def _apart(nodes: DataFrame, folder: str) -> DataFrame:
    """The nodes with a number for each: a hash of the digest, and of the digest's rank where several share one."""
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("digest")).alias("digests")).where("n > 1").select("node", "digests")
    if shared.isEmpty():
        return nodes
    told = nodes.join(shared.hint("merge"), "node", "left")
    rank = F.array_position("digests", F.col("digest"))
    return written(told.withColumn("node", F.when(rank > 1, F.xxhash64("digest", rank)).otherwise(F.col("node"))).drop("digests"), folder, "nodes-apart")


def _linked(nodes: DataFrame, n: int, threshold: float, k: int, trees: int, rounds: int, recall: float, folder: str) -> DataFrame:
    """(digest, n_links, component_id) of ``n`` nodes (node, digest, low, weight, vector) of one length."""
    slim = nodes.select("node", "vector")
    graph = None

    def counted(roots: DataFrame, name: str) -> DataFrame:
        size = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        members = join_aggregated(roots, size, ["root"]).join(nodes.select("node", "weight", "vector"), "node").select("root", "size", "node", "weight", "vector")
        return written(_blocks(members, threshold, BLOCK), folder, f"links-{name}")

    for growth in range(GROWTHS):
        grown = range(0, trees) if graph is None else range(trees * 2 ** (growth - 1), trees * 2**growth)
        k_now = k * 2**growth
        fresh = _compare(_leaves(slim, n, grown, LEAF), ["tree", "code", "cut"], k_now)
        start = written(_nearest(fresh if graph is None else graph.unionAll(fresh), k_now), folder, f"start-{growth}")
        graph = _descend(start, slim, n, k_now, rounds, folder, f"graph-{growth}")
        linked = graph.where(F.col("sim") >= threshold).select("a", "b")
        roots = written(components(linked, folder, f"components-{growth}"), folder, f"roots-{growth}")
        roots = _joined(graph, roots, slim, threshold, k_now, trees, rounds, folder, f"joined-{growth}")
        links = counted(roots, str(growth))
        share = _audit(nodes, roots, links, threshold, AUDIT)
        logger.info("share of audited vectors that have all their links: %.4f with lists of %d", share, k_now)
        if share >= recall:
            break
    else:
        roots = written(components(_all_edges(slim, n, threshold, BLOCK), folder, "components-all"), folder, "roots-all")
        links = counted(roots, "all")
    told = nodes.join(roots, "node", "left").join(links, "node", "left").select("digest", "low", "weight", F.coalesce("root", "node").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    lowest = told.groupBy("root").agg(F.min("low").alias("component_id"))
    return join_aggregated(told, lowest, ["root"]).select("digest", "n_links", "component_id")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, k: int = K, trees: int = TREES, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Links are pairs of vectors of one length with cosine of ``threshold`` or more, in double precision.  Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing.  Each length is searched
    by itself, one after the other, so there should be few.  Equal vectors are one node and link with each other.
    component_id is the smallest id reachable; a null id names no component unless all its ids are null.  Repeated
    rows are vectors of their own.  An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "neighbours")
    rows = keyed(vectors, [id_col, vector_col], folder).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), "_file", "_row")
    good = _usable(F.col("vector"))
    digest = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0)).cast("string"))), 256)
    keys = written(rows.select("id", "_file", "_row", F.when(good, digest).alias("digest")), folder, "keys")
    classes = rows.where(good).select(digest.alias("digest"), "id", "vector").groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    nodes = _apart(written(classes.select(F.xxhash64("digest").alias("node"), "digest", "low", "weight", "vector"), folder, "nodes"), folder)
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()}
    searched = [d for d, n in sizes.items() if n > 1]
    alone = nodes.where(~F.size("vector").isin(searched)) if searched else nodes
    told = alone.select("digest", (F.col("weight") - 1).alias("n_links"), F.col("low").alias("component_id"))
    for d in searched:
        own = nodes.where(F.size("vector") == d) if len(sizes) > 1 else nodes
        told = told.unionAll(_linked(own, sizes[d], threshold, k, trees, rounds, recall, f"{folder}/length-{d}"))
    out = keys.join(written(told, folder, "told").hint("merge"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
