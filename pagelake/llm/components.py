"""Connected components of a link table by union-find inside tasks and star contraction across them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.sources.store import materialise


class UnionFind:
    """Smallest member as root, path halving."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a < b:
            self.parent[b] = a
        elif b < a:
            self.parent[a] = b


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by links from each node to the smallest node it is joined with here."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(a, b)
    nodes = np.fromiter(sets.parent, np.int64, len(sets.parent))
    roots = np.fromiter((sets.root(x) for x in nodes.tolist()), np.int64, len(nodes))
    moved = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction (Kiveris et al. 2014); a is above b in every link."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and root (smallest id reachable) of every id that is not itself a root.

    ``links`` has long columns a and b. Each task first contracts its own links to a forest, held as
    a dictionary of the task's ids; then large and small stars alternate until nothing changes, a
    logarithmic number of rounds. A null on either side links nothing.
    """
    forest = links.filter("a != b").select("a", "b").mapInArrow(_contract, "a long, b long")
    links = materialise(forest.filter("a > b"), "links")
    seen = None
    while True:
        links = materialise(_star(_star(links, large=True), large=False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = now
