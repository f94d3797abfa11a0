"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios (Wang and Manning 2012).

Features are the distinct byte n-grams of a text (A-Z lower-cased, runs of white space as one blank),
hashed into ``2^bits`` buckets. The log-count ratio of a bucket compares how many toxic and clean
labelled texts hold it, counted over every labelled training row by one aggregation; it is drawn towards 0 by
``doubt`` standard errors, so that buckets seen a few times do not count. A logistic
regression learns weights for the features scaled by these ratios on all labelled training rows: the rows are
stored once as gaps between their buckets, and for each step of a quasi-Newton method (L-BFGS) the tasks add
up loss and gradient of their rows and Spark adds the sums. The driver holds the model and the last few
gradients. The model is ``2^bits`` numbers, whatever the corpus. Scoring is one narrow pass over
whole texts.

Rows with a null label teach nothing; of several labels of a document the toxic one counts. A null
text is an empty one. Without toxic or without clean training rows every score is the share of
toxic ones (0 without any). Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import SLICE_BYTES, fold, gram_hashes, mix, slices
from pagelake.sources.store import materialise


class Shape(NamedTuple):
    """n-gram lengths, hash bits, smoothing, doubt, penalty, threshold."""

    lengths: tuple[int, ...] = (4, 6, 8)
    bits: int = 18
    smoothing: float = 1.0
    doubt: float = 1.0
    penalty: float = 1.0
    threshold: float = 0.3


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


#: Weights per row of the gradient's sums, and bytes of stored rows read at once.
_CHUNK, _PIECE = 1 << 12, 1 << 20
#: Bytes of text hashed at once: what is made of them stays in the processor's cache.
_SLICE = 1 << 17
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("A") : ord("Z") + 1] += 32
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_BLANK = _CLASS == 0x20
_BYTE = mix((_CLASS + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15))


def grams(values: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Buckets of the windows of each length."""
    return [(gram_hashes(values, k) >> np.uint64(64 - shape.bits)).astype(np.int32) for k in shape.lengths]


def features(text: str | None, shape: Shape, piece: int = 1 << 20) -> np.ndarray:
    """Distinct buckets of a text, sorted; long texts are read in overlapping pieces."""
    raw = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
    codes = np.frombuffer(raw, np.uint8)
    blank = _BLANK[codes]
    values = _BYTE[codes[~(blank & np.concatenate(([False], blank[:-1])))]]
    found = [np.zeros(0, np.int32)]
    longest = max(shape.lengths)
    for a in range(0, len(values), piece):
        found.append(np.unique(np.concatenate(grams(values[a : a + piece + longest - 1], shape))))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def slice_features(column: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts of a slice in a row, and how many stand before each text.

    The n-grams of the slice are hashed at once; each text then notes its buckets in one reused array, so
    none is sorted. The features of a text come in no particular order.
    """
    texts = column.cast(pa.binary()).fill_null(b"").to_pylist()
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
        found = features(column[0].as_py(), shape)
        return np.array([0, len(found)]), found
    raw = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    starts = np.cumsum(sizes) - sizes
    blank = _BLANK[raw]
    again = np.append(False, blank[:-1]) & blank
    again[starts] = False
    kept = np.flatnonzero(~again)
    edges = np.append(np.searchsorted(kept, starts), len(kept)).tolist()
    made = grams(_BYTE[raw[kept]], shape)
    last, found = np.empty(1 << shape.bits, np.int32), []
    for a, b in zip(edges, edges[1:]):
        # windows that reach into the next text are left out; of equal buckets the one written last stays
        mine = np.concatenate([g[a : max(b - k + 1, a)] for k, g in zip(shape.lengths, made)])
        place = np.arange(len(mine), dtype=np.int32)
        last[mine] = place
        found.append(mine[last[mine] == place])
    return np.cumsum([0, *map(len, found)]), np.concatenate(found)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training texts with their label, stored once."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # labels grow with the corpus: always by shuffle, so that small and large runs take the same way
    return materialise(docs.select("doc_id", "text").join(marks.hint("shuffle_merge"), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic")), "labelled")


def _counts(rows: DataFrame, shape: Shape) -> DataFrame:
    """bucket, toxic and clean: texts of each label that hold the bucket; bucket -1 counts the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, (1 << shape.bits) + 1), np.int64)
        for batch in slices(batches, limit=_SLICE):
            first, found = slice_features(batch.column("text"), shape)
            for i, toxic in enumerate(batch.column("toxic").to_pylist()):
                totals[int(not toxic), found[first[i] : first[i + 1]] + 1] += 1
                totals[int(not toxic), 0] += 1
        used = np.flatnonzero(totals.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used - 1), *(pa.array(t[used]) for t in totals)], ["bucket", "toxic", "clean"])

    partial = rows.select("text", "toxic").mapInArrow(run, "bucket long, toxic long, clean long")
    return partial.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def pack(buckets: np.ndarray) -> bytes:
    """Gaps of sorted buckets; a byte of 255 means that the gap goes on."""
    more, last = np.divmod(np.diff(buckets, prepend=0), 255)
    made = np.full(len(buckets) + int(more.sum()), 255, np.uint8)
    made[np.cumsum(more + 1) - 1] = last
    return made.tobytes()


def unpack(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in pieces: the rows of the piece, and row (in the piece) and bucket of every feature."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + _PIECE, "right")) - 1)
        gaps, cuts = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        sums = np.concatenate(([0], np.cumsum(gaps, dtype=np.int64)))
        full = gaps != 255
        row = np.repeat(np.arange(b - a), np.diff(cuts))[full]
        yield slice(a, b), row, sums[1:][full] - sums[cuts[:-1]][row]
        a = b


def _packed(rows: DataFrame, useful: np.ndarray, shape: Shape) -> DataFrame:
    """Label and useful features of every labelled training row, stored once."""
    shared = rows.sparkSession.sparkContext.broadcast(useful)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slices(batches, limit=_SLICE):
            first, found = slice_features(batch.column("text"), shape)
            packed = [pack(np.sort((f := found[a:b])[wanted[f]])) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary())], ["toxic", "buckets"])

    return materialise(rows.select("text", "toxic").mapInArrow(run, "toxic boolean, buckets binary"), "features")


def _slope(packed: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    """Gradient of the logistic loss over all rows by weight, then by bias, and the loss."""
    size = len(weights)
    shared = packed.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        sums = np.zeros(size + 2)
        for batch in batches:
            labels = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)
            for part, row, bucket in unpack(batch.column("buckets")):
                y = labels[part]
                z = np.bincount(row, w[bucket], len(y)) + b
                g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                sums[:size] += np.bincount(bucket, g[row], size)
                sums[size:] += g.sum(), (np.logaddexp(0, z) - y * z).sum()
        pieces = [sums[a : a + _CHUNK].tobytes() for a in range(0, len(sums), _CHUNK)]
        task = pa.array([TaskContext.get().partitionId()] * len(pieces), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), task, pa.array(pieces, pa.binary())], ["chunk", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(x.as_py()) for x in table.sort_by("task")["sums"])  # in order, so that runs agree
        return pa.table({"chunk": table["chunk"][:1], "sums": pa.array([added.tobytes()], pa.binary())})

    parts = packed.mapInArrow(run, "chunk int, task int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect()
    shared.destroy()
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(parts, key=lambda r: r["chunk"])])


def minimise(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 150, held: int = 10, tolerance: float = 1e-3) -> np.ndarray:
    """L-BFGS of a convex function until its gradient is ``tolerance`` of the first one."""
    loss, g = slope(x)
    least = tolerance * np.linalg.norm(g)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.linalg.norm(g) <= least:
            break
        d, gains = g.copy(), []
        for s, y, r in reversed(moves):
            gains.append(r * (s @ d))
            d -= gains[-1] * y
        d *= 1 / (moves[-1][2] * (moves[-1][1] @ moves[-1][1])) if moves else 1 / np.linalg.norm(g)
        for (s, y, r), gain in zip(moves, reversed(gains)):
            d += (gain - r * (y @ d)) * s
        step, fall = 1.0, g @ d
        while step > 1e-6:
            new_loss, new_g = slope(x - step * d)
            if new_loss <= loss - 1e-4 * step * fall:
                break
            step /= 2
        else:
            break  # no further descent in floating point
        s, y = -step * d, new_g - g
        if s @ y > 0:
            moves = [*moves, (s, y, 1 / (s @ y))][-held:]
        x, loss, g = x + s, new_loss, new_g
    return x


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Model:
    """The model from the labelled rows of ``docs``, which the caller restricts to training rows."""
    rows = _labelled(docs, labels)
    counts = _counts(rows, shape).toArrow()  # one row per bucket at most: 2^bits + 1
    grid = np.zeros((2, (1 << shape.bits) + 1))
    for row, name in enumerate(("toxic", "clean")):
        grid[row, counts["bucket"].to_numpy() + 1] = counts[name].to_numpy()
    texts = grid[:, 0]
    if not texts.all():
        return Model(np.zeros(1 << shape.bits, np.float32), 30.0 if texts[0] else -30.0)
    share = (grid[:, 1:] + shape.smoothing) / (texts[:, None] + 2 * shape.smoothing)
    ratio = np.log(share[0] / share[1])
    error = np.sqrt((1 / (grid[:, 1:] + shape.smoothing)).sum(0))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - shape.doubt * error, 0)
    packed = _packed(rows, ratio != 0, shape)

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        sums = _slope(packed, w * ratio, x[-1])
        return sums[-1] + shape.penalty / 2 * (w @ w), np.append(sums[:-2] * ratio + shape.penalty * w, sums[-2])

    x = minimise(slope, np.append(np.zeros(len(ratio)), np.log(texts[0] / texts[1])))
    return Model((x[:-1] * ratio).astype(np.float32), float(x[-1]))


def score(docs: DataFrame, model: Model, shape: Shape = Shape()) -> DataFrame:
    """doc_id, row (xxhash64 of the text) and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # 4 * 2^bits bytes
    bias = model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in slices(batches, limit=_SLICE):
            first, found = slice_features(batch.column("text"), shape)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            z = np.bincount(owner, weights[found], batch.num_rows) + bias
            made = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(made, pa.float64())], [*batch.schema.names[:1], *batch.schema.names[2:], "score"])

    narrow = docs.select("doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return narrow.mapInArrow(run, f"{kinds}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), divisor: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of rows with crc32(id) mod divisor = held stay unseen."""
    marked = docs.select("doc_id", "text", fold(docs, divisor, held).alias("held_out"))
    model = train(marked.filter("NOT held_out"), labels, shape)
    scored = score(marked, model, shape)
    return scored.withColumn("predicted", (F.col("score") >= shape.threshold).cast("int"))
