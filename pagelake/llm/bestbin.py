"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on the driver on at most ``sample`` vectors (those of smallest id hash, a
documented bound); every vector is then put into its leaf by tasks. A query walks the tree through a
priority queue: the node with the best estimate (inner product with the centroid plus ``reach``
times the node's radius and the query's length) is opened next, and each opened leaf is a visit.
How many visits are needed is calibrated: for at most ``probes`` queries the true neighbours are
found by brute force over all vectors, the place of their leaves in each walk gives recall as a
function of visits, and the smallest number that reaches ``recall`` is taken. A query goes on past
it while the visited leaves hold no more than k vectors.

Visits meet vectors leaf by leaf, in blocks of at most about ``block`` vectors and queries, so a leaf
that holds a third of all rows is many tasks. Blocks are compared exactly in double precision;
equal vectors get equal scores and ties go to the smaller id. The tree, its leaf counts and the
probes are bounded by the shape, whatever the table.

Vectors that are null, all zero or hold null or non-finite components take no part, nor do rows
without an id and vectors of another length than the most common. Rows that repeat an id are candidates
and queries each of its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.sources.store import materialise


class Shape(NamedTuple):
    """Neighbours, sampled vectors, children per node, sampled vectors per leaf, probes, recall, reach, block."""

    k: int = 20
    sample: int = 20_000
    branch: int = 8
    leaf: int = 64
    probes: int = 200
    recall: float = 0.95
    reach: float = 0.5
    block: int = 4096
    seed: int = 11


class Tree(NamedTuple):
    """Nodes in breadth order: centroid, radius, first child (0 for a leaf), children, number of the leaf."""

    centroids: np.ndarray
    radii: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.children == 0).sum())


def k_means(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Label of each point; seeds are drawn by squared distance."""
    centers = points[random.integers(len(points))][None]
    gap = ((points - centers[0]) ** 2).sum(1)
    while len(centers) < k and gap.sum() > 0:
        centers = np.vstack((centers, points[random.choice(len(points), p=gap / gap.sum())]))
        gap = np.minimum(gap, ((points - centers[-1]) ** 2).sum(1))
    labels = np.zeros(len(points), np.intp)
    for _ in range(rounds):
        labels = nearest(points, centers)
        sums = np.stack([np.bincount(labels, points[:, d], len(centers)) for d in range(points.shape[1])], 1)
        held = np.bincount(labels, minlength=len(centers))
        moved = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return labels


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)


def fit(points: np.ndarray, shape: Shape) -> Tree:
    random = np.random.default_rng(shape.seed)
    parts, centroids, radii, child, children = [points], [], [], [], []
    at = 0
    while at < len(parts):
        part = parts[at]
        center = part.mean(0)
        centroids.append(center)
        radii.append(float(np.sqrt(((part - center) ** 2).sum(1).mean())))
        labels = k_means(part, shape.branch, random) if len(part) > shape.leaf else np.zeros(len(part), np.intp)
        split = [part[labels == c] for c in np.unique(labels)]
        child.append(len(parts) if len(split) > 1 else 0)
        children.append(len(split) if len(split) > 1 else 0)
        if len(split) > 1:
            parts += split
        parts[at] = part[:0]
        at += 1
    inner = np.array(children)
    leaf = np.where(inner == 0, np.cumsum(inner == 0) - 1, -1)
    return Tree(np.array(centroids), np.array(radii), np.array(child), inner, leaf)


def leaf_of(points: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of each point: down to the nearest child, all points of a node together."""
    node = np.zeros(len(points), np.intp)
    open_ = [0]
    while open_:
        n = open_.pop()
        if tree.children[n] == 0:
            continue
        rows = np.flatnonzero(node == n)
        if len(rows):
            a, b = tree.child[n], tree.child[n] + tree.children[n]
            node[rows] = a + nearest(points[rows], tree.centroids[a:b])
            open_ += range(a, b)
    return tree.leaf[node]


def walk(query: np.ndarray, tree: Tree, reach: float) -> Iterator[int]:
    """Leaves in best-bin-first order."""
    estimate = tree.centroids @ query + reach * float(np.linalg.norm(query)) * tree.radii
    queue = [(-estimate[0], 0)]
    while queue:
        _, n = heapq.heappop(queue)
        if tree.children[n] == 0:
            yield int(tree.leaf[n])
        for c in range(tree.child[n], tree.child[n] + tree.children[n]):
            heapq.heappush(queue, (-estimate[c], c))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors of a list column as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def best(query: np.ndarray, own: int, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best vectors and their scores; ``own`` is the query's row, ``rough`` are the inner products up to rounding."""
    near = np.arange(len(ids))
    if len(ids) > k + 1:
        bar = -np.partition(-rough, k)[k]  # one more than k, for the query's own row
        near = np.flatnonzero(rough >= bar - 1e-9 * (1 + abs(bar)))
    near = near[row[near] != own]
    score = (vectors[near] * query).sum(1)  # summed in one order, so that equal vectors tie
    order = np.lexsort((ids[near], -score))[:k]
    return near[order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part, a row each."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )


def _truth(index: DataFrame, probes: np.ndarray, own: np.ndarray, k: int, d: int) -> DataFrame:
    """probe and leaf of the k true neighbours of each probe."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, ids, vectors = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), d)
            rough = probes @ vectors.T
            found = [best(q, o, row, ids, vectors, r, k) for q, o, r in zip(probes, own, rough)]
            rows = np.concatenate([f[0] for f in found])
            probe = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            made = [pa.array(probe), pa.array(ids[rows]), pa.array(np.concatenate([f[1] for f in found])), batch.column("leaf").take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays(made, ["probe", "vec_id", "score", "leaf"])

    found = index.mapInArrow(run, "probe long, vec_id long, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("probe", "leaf")


def calibrate(tree: Tree, probes: np.ndarray, truth: list[tuple[int, int]], shape: Shape) -> int:
    """Fewest visits at which the probes find ``recall`` of their true neighbours."""
    places = [{leaf: i for i, leaf in enumerate(walk(q, tree, shape.reach))} for q in probes]
    needed = np.sort([places[p][leaf] + 1 for p, leaf in truth])
    return int(needed[int(np.ceil(shape.recall * len(needed))) - 1]) if len(needed) else 1


def _visits(queries: DataFrame, tree: Tree, held: np.ndarray, visits: int, shape: Shape, d: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, leaves = [], []
            for i, q in enumerate(matrix(batch.column("embedding"), d)):
                seen = 0
                for n, leaf in enumerate(walk(q, tree, shape.reach)):
                    if n >= visits and seen > shape.k:
                        break
                    seen += held[leaf]
                    if held[leaf]:
                        rows.append(i)
                        leaves.append(leaf)
            at = pa.array(rows, pa.int64())
            made = [batch.column(c).take(at) for c in ("asker", "query_id", "embedding")]
            yield pa.RecordBatch.from_arrays([*made, pa.array(leaves, pa.int32())], ["asker", "query_id", "query", "leaf"])

    return queries.mapInArrow(run, "asker long, query_id long, query array<double>, leaf int")


def _dealt(rows: DataFrame, blocks: DataFrame, own: str, id_: str, other: str) -> DataFrame:
    """Rows with a block of their own side, once for each block of the other side."""
    number = F.pmod(F.xxhash64(id_), F.col(own)).cast("int")
    return rows.join(F.broadcast(blocks), "leaf").withColumn(f"{own}_no", number).withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def search(vectors: DataFrame, is_query: Column, shape: Shape = Shape()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each query.

    Every row is a candidate, and every query row a query of its own, also where an id repeats; only the
    query's own row is left out.
    """
    spark = vectors.sparkSession
    kept = usable(vectors)
    sizes = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, k = sizes["d"], shape.k
    kept = kept.filter(F.size("embedding") == d)
    hashed = F.xxhash64("vec_id", F.lit(shape.seed))
    points = np.array([r.embedding for r in kept.orderBy(hashed, "vec_id", "embedding").limit(shape.sample).select("embedding").toLocalIterator()], np.float64)
    tree = fit(points, shape)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(matrix(batch.column("embedding"), d), tree) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["vec_id", "embedding", "leaf"])

    placed = kept.mapInArrow(place, "vec_id long, embedding array<double>, leaf int")
    index = materialise(placed.withColumn("row", F.monotonically_increasing_id()), "index")
    queries = index.filter(is_query).select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), "embedding")
    probed = queries.orderBy(F.xxhash64("query_id"), "query_id", "embedding").limit(shape.probes).collect()
    probes = np.array([r.embedding for r in probed], np.float64).reshape(-1, d)
    truth = [tuple(r) for r in _truth(index, probes, np.array([r.asker for r in probed], np.int64), k, d).collect()] if probed else []
    visits = calibrate(tree, probes, truth, shape)
    held = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # one row per leaf
        held[r["leaf"]] = r["count"]
    visited = materialise(_visits(queries, tree, held, visits, shape, d), "visits")
    asked = {r["leaf"]: r["count"] for r in visited.groupBy("leaf").count().collect()}
    blocks = spark.createDataFrame(
        [(leaf, int(-(-held[leaf] // shape.block)), -(-n // shape.block)) for leaf, n in asked.items()], "leaf int, v int, q int"
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        row, ids, vectors_ = right["row"].to_numpy(), right["vec_id"].to_numpy(), matrix(right["embedding"], d)
        asking, named = left["asker"].to_numpy(), left["query_id"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(asking):
            wanted = matrix(left["query"], d)
            for a in range(0, len(wanted), 256):
                for q, o, i, r in zip(wanted[a : a + 256], asking[a : a + 256], named[a : a + 256], wanted[a : a + 256] @ vectors_.T):
                    rows, score = best(q, o, row, ids, vectors_, r, k)
                    out.append((np.full(len(rows), o), np.full(len(rows), i), ids[rows], score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0)]
        return pa.table(dict(zip(("asker", "query_id", "vec_id", "score"), columns)))

    key = ("leaf", "v_no", "q_no")
    left = _dealt(visited, blocks, "q", "asker", "v").select(*key, "asker", "query_id", "query")
    right = _dealt(index, blocks, "v", "row", "q").select(*key, "row", "vec_id", "embedding")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "asker long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
