"""Merkle manifest of a dataset, kept as a persistent tree with one version per tampered row.

Leaves are hashed in Spark and numbered inside their group by a distributed sort. 1024 consecutive leaves
are an aligned block, whose small tree one task builds; the block roots are the leaves of the next storey,
built the same way until every group has one node, its subroot, and the ordered subroots give the root.
A tampered leaf makes a version of the tree: inside its block only the ancestors of the leaf are copied
(every other node is that of the first version, read in place), and the block's new root goes on upwards
as a row that meets the shared nodes beside its way, storey by storey, so versions are spread over the
cluster like rows and no task holds a version whole.

A run of nodes is two consecutive ones of a level, or the last alone; its parent is the hash of both digests
(hex text), or of the one. Nodes are hashed so while a group has more than one. A group's rows may be any
share of the table: it is cut into blocks, and block roots are 1/1024 of its rows per storey.

Leaves ascend by key (null first), then by digest: rows that repeat a key are leaves of their own, and equal
rows have equal leaves at neighbouring places. A null group is a group and comes first; groups ascend by
UTF-8 bytes. Null fields count as ``-``, an empty text as ``0:``. An empty table gives no rows. Other columns
are not read. A group of one leaf has that leaf as its subroot, and a lone subroot is the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.ranked import number_rows
from pagelake.sources.store import broadcast_if_small, materialise

#: Levels of a block; it holds 2 ** LEVELS nodes.
LEVELS = 10
#: A sibling of a node on its way up: whether it stands left of it, and its digest.
STEP = "struct<left: boolean, digest: string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: Iterable[Column]) -> Column:
    """Digest of a row's values, each as its UTF-8 length and itself; nulls as a hyphen."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Tree:
    """Levels of an immutable tree over digests; versions share every node that they do not copy."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def beside(self, at: int) -> list[dict | None]:
        """The sibling on each level of the way up; None where a node is alone in its run."""
        found = []
        for level in self.levels[:-1]:
            other = at ^ 1
            found.append({"left": other < at, "digest": level[other]} if other < len(level) else None)
            at >>= 1
        return found

    def copied(self, at: int, leaf: str) -> list[str]:
        """The nodes that a version with another leaf does not share: the leaf and its ancestors, root last."""
        way = [leaf]
        for level in self.levels[:-1]:
            other = at ^ 1
            pair = [way[-1]] if other >= len(level) else [level[other], way[-1]] if other < at else [way[-1], level[other]]
            way.append(digest("".join(pair)))
            at >>= 1
        return way


def _levels(n: int) -> int:
    """Levels from n nodes to one."""
    return (n - 1).bit_length()


def _storey(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, grp, at, n, node, version): each with its block, way and the version's block root; the block roots.

    ``at`` counts from 0 in a group of n nodes; ``version`` is the tampered node or null. A block of at most
    1024 rows is built by one task; hot groups are many blocks.
    """
    kept = nodes.select("key", "grp", F.shiftright("at", levels).alias("block"), "at", "n", "node", "version")
    step = pa.struct([("left", pa.bool_()), ("digest", pa.string())])

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        leaves = block["node"].to_pylist()
        tree = Tree(leaves, min(levels, _levels(block["n"][0].as_py())))
        tops = [tree.copied(i, leaf if version is None else version)[-1] for i, (leaf, version) in enumerate(zip(leaves, block["version"].to_pylist()))]
        for name, kind, values in (("way", pa.list_(step), map(tree.beside, range(len(tops)))), ("root", pa.string(), [tree.root] * len(tops)), ("top", pa.string(), tops)):
            block = block.append_column(name, pa.array(list(values), kind))
        return block

    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes) + f", way array<{STEP}>, root string, top string"
    built = materialise(kept.groupBy("grp", "block").applyInArrow(build, schema), "blocks")
    more = F.shiftright(F.col("n") - 1, levels) + 1
    roots = built.filter(F.col("at") % (1 << levels) == 0).select(
        F.lit(None).cast("long").alias("key"), "grp", F.col("block").alias("at"), more.alias("n"), F.col("root").alias("node"), F.lit(None).cast("string").alias("version")
    )
    return built, roots


def _climb(start: Column, way: Column) -> Column:
    """Digest at the end of a way of siblings."""
    def parent(below: Column, beside: Column) -> Column:
        other = F.coalesce(beside["digest"], F.lit(""))
        return F.sha2(F.when(beside["left"], F.concat(other, below)).otherwise(F.concat(below, other)), 256)

    return F.aggregate(way, start, parent)


def manifest(docs: DataFrame, fields: tuple[str, ...], group: str, tampered: dict[str, Column], key: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``fields`` are hashed in that order; ``tampered`` replaces some of them by other expressions. A row's proof
    is checked by folding its leaf, as tampered, with the siblings of the tree as it is.
    """
    leaf = leaf_digest(F.col(f) for f in fields)
    other = leaf_digest(tampered.get(f, F.col(f)) for f in fields)
    leaves = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf.alias("node"), other.alias("other"))
    leaves = leaves.withColumn("version", F.when(F.col("other") != F.col("node"), F.col("other"))).drop("other")
    # equal leaves get different numbers; the version tells a tampered one from its equal
    leaves = leaves.withColumn("salt", F.monotonically_increasing_id())
    leaves = materialise(leaves, "leaves")
    placed = number_rows(leaves, ["grp"], ["key", "node", "salt"], "at").withColumn("at", F.col("at") - 1)
    sizes = broadcast_if_small(leaves.groupBy("grp").agg(F.count("*").alias("n")))
    nodes = materialise(_same(placed, sizes, ["grp"]).select("key", "grp", "at", "n", "node", "version"), "placed")

    storeys = []
    below = nodes
    while True:
        built, roots = _storey(below, levels)
        storeys.append(built)
        if roots.agg(F.max("n")).first()[0] in (None, 1):
            break
        below = roots
    # downwards: what stands above each block of the storey below
    upper = _subroots(roots, levels)
    for built in storeys[:0:-1]:
        here = built.select("grp", F.col("at").alias("block"), "way", F.col("block").alias("over"))
        joined = _same(here, upper.withColumnRenamed("block", "over"), ["grp", "over"])
        upper = materialise(joined.select("grp", "block", F.concat("way", "above").alias("above"), "subroot", "root"), "above")
    rows = _same(storeys[0].select("key", "grp", "node", "way", "block", "top"), upper, ["grp", "block"])
    whole = F.concat("way", "above")
    siblings = F.transform(F.filter(whole, lambda s: s.isNotNull()), lambda s: s["digest"])
    return rows.select(
        F.col("key").alias(key),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        _climb(F.col("top"), F.col("above")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join whose keys may be null."""
    renamed = right.select(*(F.col(c).alias(f"_{c}") if c in on else c for c in right.columns))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, same).drop(*(f"_{c}" for c in on))


def _subroots(roots: DataFrame, levels: int) -> DataFrame:
    """grp, block 0, above (the way from the subroot to the root), subroot and root of every group.

    Groups are numbered like leaves, and their subroots are one more tree of storeys.
    """
    top = number_rows(roots.select("grp", "node").withColumn("all", F.lit(0)), ["all"], ["grp"], "at")
    top = materialise(top.withColumn("at", F.col("at") - 1), "subroots")
    n = top.count()
    nodes = top.select(F.lit(None).cast("long").alias("key"), F.lit("").alias("grp"), "at", F.lit(n).cast("long").alias("n"), "node", F.lit(None).cast("string").alias("version"))
    storeys = []
    while True:
        built, nodes = _storey(nodes, levels)
        storeys.append(built)
        if nodes.agg(F.max("n")).first()[0] in (None, 1):
            break
    upper = nodes.select(F.lit(0).cast("long").alias("block"), F.array().cast(f"array<{STEP}>").alias("above"), F.col("node").alias("root"))
    for built in storeys[::-1]:
        here = built.select(F.col("at").alias("block"), "way", F.col("block").alias("over"))
        joined = here.join(upper.withColumnRenamed("block", "over"), "over")
        upper = joined.select("block", F.concat("way", "above").alias("above"), "root")
    return top.withColumnRenamed("at", "block").join(upper, "block").select(
        "grp", F.lit(0).cast("long").alias("block"), "above", F.col("node").alias("subroot"), "root"
    )
