"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

SuperMinHash (Ertl 2017): each shingle spreads one value over the slots of the signature through a
permutation of its own, so the value at a slot is (rank of the slot in the permutation) + (uniform
fraction). A slot keeps its smallest value. Ranks of one shingle are correlated (each occurs once),
which lowers the variance against independent hashes, and once every slot holds a value of rank r
no shingle's higher ranks can matter, so the work stops there: about one step per shingle for long
texts. The permutation here is slot = start + rank * odd stride modulo a power of two, and ranks
are tried for all shingles of a text together, which numpy does in whole arrays.

Results: documents with the same shingle set form one class (128-bit fingerprints). Classes that
share a band are candidates. The classes of a band bucket are first compared with its smallest, on
full sets of 64-bit shingle hashes, and linked ones merge: a large group of copies costs one
comparison per member. Where classes that met the same smallest one are still in different
components, they are compared among themselves in blocks of ``BLOCK`` sets, one task per pair of
blocks and no row per pair; blocks of the smallest one's own component need not meet each other.
Within a block pair, pairs of one component and pairs whose signatures agree in far fewer slots than
a link would (6.5 standard deviations) are passed over; all others are compared on full sets.
Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.components import UnionFind, components
from pagelake.llm.text import gram_hashes, mix, slices, split_words, word_hashes
from pagelake.sources.store import materialise

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Sets that a block holds on average.
BLOCK = 64


class Shape(NamedTuple):
    """Words per shingle, least similarity in per cent, bands and rows; bands * rows <= slots = 2^n.

    At 85 % similarity 42 bands of 6 miss a link with probability 2e-9, at 80 % with 3e-6.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    slots: int = 256


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than a shingle make one shingle."""
    words = split_words(column)
    hashes = word_hashes(words, lower=True)
    first = words.first.tolist()
    for a, b in zip(first, first[1:]):
        yield np.unique(gram_hashes(hashes[a:b], min(shingle, b - a))) if b > a else hashes[:0]


def signature(shingles: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of a non-empty set; a value holds the rank in its upper 16 bits."""
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    start = mix(shingles + _STEP)
    stride = (start >> np.uint64(32)) | np.uint64(1)
    block = max(1, -(-6 * slots // len(shingles)))  # so many ranks fill all slots as a rule
    rank = 0
    while rank < slots:
        ranks = np.arange(rank, min(slots, rank + block), dtype=np.uint64)[:, None]
        slot = (start + ranks * stride) & np.uint64(slots - 1)
        value = (ranks << np.uint64(48)) | (mix(shingles + (ranks + np.uint64(2)) * _STEP) >> np.uint64(16))
        np.minimum.at(best, slot.ravel().astype(np.intp), value.ravel())
        rank += len(ranks)
        if int(best.max() >> np.uint64(48)) < rank:
            break
    return best


def band_keys(best: np.ndarray, shape: Shape) -> np.ndarray:
    grid = best[: shape.bands * shape.rows].reshape(shape.bands, shape.rows)
    return mix(gram_hashes_of_rows(grid) + np.arange(shape.bands, dtype=np.uint64) * _STEP).view(np.int64)


def gram_hashes_of_rows(grid: np.ndarray) -> np.ndarray:
    value = np.zeros(len(grid), np.uint64)
    for column in grid.T:
        value = mix(value + column)
    return value


def _sketches(docs: DataFrame, shape: Shape) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, one, two, bands = [], [], [], []
            for s in shingle_sets(batch.column("text"), shape.shingle):
                size.append(len(s))
                one.append(int(mix(s).sum().view(np.int64)))
                two.append(int(mix(s ^ _STEP).sum().view(np.int64)))
                bands.append(band_keys(signature(s, shape.slots), shape) if len(s) else None)
            made = [pa.array(x, pa.int64()) for x in (size, one, two)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *made, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp1", "fp2", "bands"]
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _sets(docs: DataFrame, shape: Shape) -> DataFrame:
    """Full sets, their fingerprint, and the lowest byte of each slot of the signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s for s in shingle_sets(batch.column("text"), shape.shingle)]
            one = [int(mix(s).sum().view(np.int64)) for s in sets]
            two = [int(mix(s ^ _STEP).sum().view(np.int64)) for s in sets]
            slots = [signature(s, shape.slots).astype(np.uint8).tobytes() if len(s) else None for s in sets]
            made = [pa.array(x, pa.int64()) for x in (one, two)]
            made += [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(slots, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["id", "fp1", "fp2", "shingles", "slots"])

    return docs.mapInArrow(run, "id long, fp1 long, fp2 long, shingles array<long>, slots binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the intersection of two sorted sets is at least ``percent`` of their union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = [alike(np.asarray(left[i].values), np.asarray(right[i].values), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _class_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """Stored sets of the given classes (column rep)."""
    # with the class's own fingerprint: an id that occurs twice may hold another text as well
    wanted = classes.join(ids, "rep", "left_semi").select(F.col("rep").alias("id"), "fp1", "fp2")
    texts = docs.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    return materialise(_sets(texts, shape).join(wanted, ["id", "fp1", "fp2"], "left_semi").dropDuplicates(["id"]).drop("fp1", "fp2"), "sets")


def _star_links(stars: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    possible = stars.filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * shape.percent)
    pairs = possible.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    return _linked(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), shape.percent)


def _in_blocks(mixed: DataFrame) -> DataFrame:
    """hub, x, y (the pair of blocks), rep and root: each class once per pair of blocks it belongs to.

    Blocks 0, 1, ... hold classes outside the component of the hub, -1, -2, ... those of it.
    """
    size = mixed.groupBy("hub").agg(
        F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK).cast("int").alias("others"), F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("homes")
    )
    dealt = mixed.join(size, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int"))
    other = F.sequence(F.lit(0), F.col("others") - 1)
    met = F.when(F.col("home"), F.transform(other, lambda o: F.struct(o.alias("x"), (-1 - F.col("own")).alias("y")))).otherwise(
        F.concat(
            F.transform(other, lambda o: F.struct(F.least(o, "own").alias("x"), F.greatest(o, "own").alias("y"))),
            F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: F.struct(F.col("own").alias("x"), (-1 - h).alias("y"))),
        )
    )
    return dealt.select("hub", "rep", "root", F.inline(met))


def _block_links(mixed: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    share = shape.percent / 100
    least = shape.slots * share - 6.5 * (shape.slots * share * (1 - share)) ** 0.5

    def run(block: pa.Table) -> pa.Table:
        ids, roots = block["rep"].to_pylist(), block["root"].to_pylist()
        slots = np.frombuffer(b"".join(block["slots"].to_pylist()), np.uint8).reshape(len(ids), -1)
        full = [np.asarray(s.values) for s in block["shingles"]]
        joined, found = UnionFind(), []
        for i, r in enumerate(roots):
            near = np.flatnonzero((slots[i + 1 :] == slots[i]).sum(1) >= least) + i + 1
            for j in near.tolist():
                if joined.root(r) != joined.root(roots[j]) and alike(full[i], full[j], shape.percent):
                    joined.join(r, roots[j])
                    found.append((ids[i], ids[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = _in_blocks(mixed).join(sets.withColumnRenamed("id", "rep"), "rep")
    return rows.groupBy("hub", "x", "y").applyInArrow(run, "a long, b long")


def class_links(docs: DataFrame, sketches: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets (fp1, fp2, rep) and links (a, b) that join them as all links would."""
    classes = materialise(
        sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
    )
    spread = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    hubs = spread.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("h"), F.max("rep").alias("high")).filter("h.rep < high")
    met = spread.join(hubs.select("band", F.col("h.rep").alias("hub"), F.col("h.n").alias("m")), "band")
    stars = materialise(met.filter("rep <> hub").select("hub", "m", "rep", "n").distinct(), "stars")
    sets = _class_sets(stars.select(F.explode(F.array("hub", "rep")).alias("rep")).distinct(), docs, classes, shape)
    links = materialise(_star_links(stars, sets, shape), "starlinks")
    roots = materialise(components(links), "roots")
    named = stars.select("hub", "rep").unionByName(stars.select("hub", F.col("hub").alias("rep")).distinct())
    named = named.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    apart = named.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("root"))).alias("home"), F.count("*").alias("k"))
    # two classes have been compared with each other already
    mixed = named.join(apart.filter("low < high AND k > 2").select("hub", F.col("home").alias("at")), "hub").select("hub", "rep", "root", (F.col("root") == F.col("at")).alias("home"))
    more = materialise(_block_links(mixed, sets, shape), "blocklinks")
    return classes.select("fp1", "fp2", "rep"), links.unionByName(more)


def near_duplicates(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and stay alone. A row without an id links with
    nothing, is kept and has a null component. Rows that repeat an id are one node; each row is
    returned. Ties need no rule: the smallest id of a component is kept. Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialise(_sketches(narrow, shape), "sketches")
    classes, links = class_links(narrow, sketches, shape)
    roots = components(links).withColumnRenamed("id", "rep")
    homes = classes.join(roots, "rep", "left").select("fp1", "fp2", F.coalesce("root", "rep").alias("home"))
    rows = sketches.drop("bands").join(homes, ["fp1", "fp2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("home")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
