"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``length`` consecutive words. The hashes of its ``gram``-word grams have a smallest one,
its minimiser; equal windows have equal minimisers. Consecutive windows that share a
minimiser form a super-k-mer, a run of words that travels as one packed string to the bucket of its
minimiser, where its windows are sorted and counted exactly, as text.

1. One narrow pass finds each document's runs (minimiser, start, count), its word count and the
   SHA-256 of its words. Of documents with the same words the smallest id alone goes on: the others
   are covered whole.
2. A minimiser that occurs in one document only cannot hold a shared window. One aggregation with a
   partial step keeps the others, so only runs that may repeat are packed and sent.
3. Buckets are sorted by (minimiser, text) and read as a stream, one minimiser at a time.
4. A minimiser with more than ``crowd`` runs would make a large bucket. Its windows go, by 128-bit
   digest, through an aggregation that combines in the map tasks and a join that adaptive execution
   can split, after equal runs have met in the same way: the same answer for groups of any size.

Windows are judged on the input. Null texts have no words; rows without an id neither remove nor
lose anything; rows that repeat an id are not earlier than each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import gram_hashes, slices, split_words, word_hashes
from pagelake.sources.store import materialise

_KEY = ["doc_id", "key"]
_RUN = "struct<mini: long, start: int, n: int>"


class Shape(NamedTuple):
    """Words per window, words per minimiser gram, runs beyond which a minimiser is a crowd."""

    length: int = 50
    gram: int = 16
    crowd: int = 256


def runs_of(hashes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each run of a text's windows.

    Windows are told apart by the minimiser's value, so a text that repeats itself makes one long run.
    """
    grams = gram_hashes(hashes, shape.gram)
    small = smallest(grams, shape.length - shape.gram + 1)
    start = np.flatnonzero(np.concatenate(([True], small[1:] != small[:-1])))
    return small[start].view(np.int64), start, np.diff(np.concatenate((start, [len(small)])))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in each window of ``width`` values."""
    n = len(values) - width + 1
    out, reach = values, 1
    while reach < width:  # windows of 2, 4, ... values, the last step overlapping
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out[:n]


def word_list(text: str | None) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six white-space bytes that separate words."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(docs: DataFrame, shape: Shape) -> DataFrame:
    kind = pa.list_(pa.struct([("mini", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            words = split_words(column)
            hashes = word_hashes(words)
            first = words.first.tolist()
            n_words, sums, sizes, parts = [], [], [0], []
            for i, (a, b) in enumerate(zip(first, first[1:])):
                n_words.append(b - a)
                sums.append(sha256(word_list(column[i].as_py())))
                if b - a >= shape.length:
                    parts.append(runs_of(hashes[a:b], shape))
                    sizes.append(sizes[-1] + len(parts[-1][0]))
                else:
                    sizes.append(sizes[-1])
            mini, start, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            items = pa.StructArray.from_arrays([pa.array(mini), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["mini", "start", "n"])
            runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(sums), runs.cast(kind)],
                ["doc_id", "key", "n_words", "sha", "runs"],
            )

    return docs.mapInArrow(run, f"doc_id long, key long, n_words long, sha string, runs array<{_RUN}>")


def _pack(texts: DataFrame, shape: Shape) -> DataFrame:
    """One row per run that may repeat: its words as one string."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, key, mini, start, n, packed, crowd = [], [], [], [], [], [], []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist())
            for d, k, text, runs in rows:
                words = word_list(text)
                for r in runs:
                    doc.append(d)
                    key.append(k)
                    mini.append(r["mini"])
                    start.append(r["start"])
                    n.append(r["n"])
                    packed.append(b" ".join(words[r["start"] : r["start"] + r["n"] + shape.length - 1]))
                    crowd.append(r["crowd"])
            made = [pa.array(x, pa.int64()) for x in (doc, key, mini)]
            made += [pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(packed, pa.binary()), pa.array(crowd, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "key", "mini", "start", "n", "packed", "crowd"])

    return texts.mapInArrow(run, "doc_id long, key long, mini long, start int, n int, packed binary, crowd boolean")


def windows(packed: bytes, length: int) -> list[bytes]:
    """The windows of a packed run, as slices of it."""
    cuts = np.concatenate(([-1], np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20), [len(packed)])).tolist()
    return [packed[cuts[i] + 1 : cuts[i + length]] for i in range(len(cuts) - length)]


def _sort_buckets(runs: DataFrame, shape: Shape) -> DataFrame:
    """Windows of each minimiser sorted as text; the later documents' windows, as word ranges."""

    def repeated(group: list[tuple]) -> Iterator[tuple]:
        found = []
        for d, k, start, packed in group:
            found += [(w, d, k, start + i) for i, w in enumerate(windows(packed, shape.length))]
        found.sort()
        text, smallest = None, None
        for w, d, k, at in found:
            if w != text:
                text, smallest = w, d
            elif d > smallest:
                yield d, k, at

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            mini, group = None, []
            for batch in batches:
                for m, *row in zip(*(batch.column(c).to_pylist() for c in ("mini", "doc_id", "key", "start", "packed"))):
                    if m != mini:
                        yield from repeated(group)
                        mini, group = m, []
                    group.append(row)
            yield from repeated(group)

        yield from _ranges(rows(), shape.length)

    dealt = runs.repartition(F.col("mini")).sortWithinPartitions("mini", "packed")
    return dealt.mapInArrow(run, "doc_id long, key long, lo int, hi int")


def _ranges(rows: Iterable[tuple], length: int, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Join the windows of a document that overlap, as far as they come together."""
    block: list[tuple] = []

    def cut() -> pa.RecordBatch:
        block.sort()
        out: list[list] = []
        for d, k, at in block:
            if out and out[-1][0] == d and out[-1][1] == k and at <= out[-1][3]:
                out[-1][3] = max(out[-1][3], at + length)
            else:
                out.append([d, k, at, at + length])
        block.clear()
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "key", "lo", "hi"])

    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield cut()
    yield cut()


def _halves(digests: bytearray) -> list[pa.Array]:
    grid = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(grid[:, i])) for i in (0, 1)]


def _digests(runs: DataFrame, shape: Shape) -> DataFrame:
    """A row per distinct window of each run: its 128-bit digest and its places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 17):
            doc, key, at, both = [], [], [], bytearray()
            for d, k, start, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "start", "packed"))):
                places: dict[bytes, list[int]] = {}
                for i, w in enumerate(windows(packed, shape.length)):
                    places.setdefault(w, []).append(start + i)
                for w, p in places.items():
                    doc.append(d)
                    key.append(k)
                    at.append(p)
                    both += hashlib.blake2b(w, digest_size=16).digest()
            made = [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*made, *_halves(both)], ["doc_id", "key", "at", "w1", "w2"])

    return runs.mapInArrow(run, "doc_id long, key long, at array<int>, w1 long, w2 long")


def _count_crowds(runs: DataFrame, shape: Shape) -> DataFrame:
    """Word ranges of the crowds' repeated windows.

    Equal runs meet first: all but those of the smallest id are repeated whole, and only these one
    or few are taken apart into windows.
    """
    marked = runs.withColumn("r1", F.xxhash64("packed")).withColumn("r2", F.md5("packed"))
    firsts = marked.groupBy("r1", "r2").agg(F.min("doc_id").alias("low"))
    ranked = marked.join(firsts, ["r1", "r2"])
    hi = F.col("start") + F.col("n") + F.lit(shape.length - 1)
    whole = ranked.filter("doc_id > low").select("doc_id", "key", F.col("start").alias("lo"), hi.cast("int").alias("hi"))
    found = _digests(ranked.filter("doc_id = low"), shape)
    shared = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    later = found.join(shared.select("w1", "w2", "low"), ["w1", "w2"]).filter("doc_id > low").select("doc_id", "key", "at")
    # windows of a document come together only after this exchange; a list of places per document
    per_doc = later.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("at")).alias("at"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((d, k, p) for d, k, at in zip(*(batch.column(c).to_pylist() for c in range(3))) for p in at)
            yield from _ranges(rows, shape.length)

    return whole.unionByName(per_doc.mapInArrow(run, "doc_id long, key long, lo int, hi int"))


def _cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """Words left in each text without the given word ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gone, sums, left = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = word_list(text)
                keep = np.ones(len(words), bool)
                for r in ranges:
                    keep[r["lo"] : r["hi"]] = False
                kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                gone.append(len(words) - len(kept))
                sums.append(sha256(kept))
                left.append(b" ".join(kept).decode("utf-8", "surrogatepass") if with_text else None)
            made = [batch.column("doc_id"), batch.column("key"), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*made, pa.array(left, pa.string())], [*_KEY, "gone", "left_sha", "left_text"])

    return texts.mapInArrow(run, "doc_id long, key long, gone long, left_sha string, left_text string")


def repeated_words(docs: DataFrame, shape: Shape = Shape(), with_text: bool = False) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_words, n_removed, kept_sha256 of every row of ``docs``.

    With ``with_text`` also left_text, the kept words, for rows that lost some (else null).
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    read = materialise(_read(narrow, shape), "runs")
    long_enough = read.filter(f"n_words >= {shape.length} AND doc_id IS NOT NULL")
    firsts = long_enough.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    runs = (
        long_enough.select("doc_id", "key", "runs")
        .join(firsts.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select("doc_id", "key", F.inline("runs"))
    )
    shared = (
        runs.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("k"))
        .filter("low < high").select("mini", (F.col("k") > shape.crowd).alias("crowd"))
    )
    wanted = runs.join(shared, "mini").groupBy(*_KEY).agg(F.collect_set(F.struct("mini", "start", "n", "crowd")).alias("runs"))
    texts = materialise(narrow.join(wanted, _KEY).dropDuplicates(_KEY), "texts")
    packed = materialise(_pack(texts, shape), "packed")
    ranges = _sort_buckets(packed.filter("NOT crowd"), shape).unionByName(_count_crowds(packed.filter("crowd"), shape))
    per_doc = ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    lost = _cut(texts.drop("runs").join(per_doc, _KEY), with_text)
    rows = read.drop("runs").join(firsts, "sha", "left").join(lost, _KEY, "left")
    copy = F.coalesce((F.col("n_words") >= shape.length) & (F.col("first_id") < F.col("doc_id")), F.lit(False))
    out = rows.select(
        *_KEY,
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(sha256([]))).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("left_text")).alias("left_text"),
    )
    return out if with_text else out.drop("left_text")
