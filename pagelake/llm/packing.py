"""Best-fit packing of tokenised documents into sequences, with certified numbers of sequences.

Each row becomes its tokens (those of its text, then one end) and is cut only if they exceed a sequence;
full pieces are sequences of their own. The other pieces are dealt to partitions by a hash of their row,
whatever their language or source, and each partition runs best-fit decreasing: the longest piece first,
into the fullest sequence that still takes it. Dual feasible functions then bound the sequences that any
packing of the partition needs: for a threshold t up to half a sequence, pieces longer than a sequence
less t count whole, pieces shorter than t nothing, the rest their length; the bound is the largest sum over
all t, in sequences. A partition that meets its bound is certified and keeps all but its emptiest sequence;
one with a gap gives up every sequence that is not full. What was given up meets in fewer partitions and is
packed again, so pieces are exchanged and the last parts of sequences are filled by those of other
partitions, until one partition is left or the total equals the bound of the whole table.

Lengths are whole numbers of at most ``capacity``, so the bound of the table needs only its counts per
length. A partition holds about ``per_partition`` narrow rows (no tokens), by their counted number.

A null or empty text is the end token alone. Rows that repeat an id, or id and text, are each packed; a null
id is kept. Equal lengths go by row. An empty table gives no rows. Other columns are not read. A lost
executor repeats the same work: rows are numbered in a written table, and partitions sort them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.wordpieces import encoder
from pagelake.sources.store import materialise


class Shape(NamedTuple):
    """Tokens of a sequence, id of the end, rows a partition packs, most rounds."""

    capacity: int = 4096
    end: int = 1
    per_partition: int = 100_000
    rounds: int = 8


class Bins:
    """Open sequences by room left; finds the fullest that takes a piece in a few steps.

    Bit r of ``there`` tells that some sequence has room for exactly r more tokens.
    """

    def __init__(self, capacity: int):
        self.capacity, self.there, self.made = capacity, 0, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece."""
        fit = self.there >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            at = self.open[room].pop()
            if not self.open[room]:
                self.there ^= 1 << room
        else:
            room, at = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            self.open[left].append(at)
            self.there |= 1 << left
        return at, self.capacity - room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences; equal lengths in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins = Bins(capacity)
    placed = np.array([bins.put(n) for n in lengths[order].tolist()], np.int64).reshape(-1, 2)
    where = np.empty_like(placed)
    where[order] = placed
    return where[:, 0], where[:, 1], bins.made


def bound(counts: np.ndarray, capacity: int) -> int:
    """Least sequences for counts[n] pieces of n tokens, by the best of all thresholds up to capacity / 2."""
    size = np.arange(len(counts))
    pieces, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * size))
    t = np.arange(capacity // 2 + 1)
    large = pieces[-1] - pieces[capacity - t + 1]
    middle = tokens[capacity - t + 1] - tokens[t]
    return int((large + -(-middle // capacity)).max())


def pieces(docs: DataFrame, path: str, shape: Shape = Shape(), text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece (and its ids); one narrow stage without shuffle."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            owner, columns, kept = [], [[], [], [], []], []
            for i, found in enumerate(encode.texts(batch.column(1))):
                ids = np.append(found, np.uint32(shape.end))
                for k, start in enumerate(range(0, len(ids), shape.capacity)):
                    part = ids[start : start + shape.capacity]
                    owner.append(i)
                    for column, value in zip(columns, (k, start, len(part), zlib.crc32(part.astype("<u4").data))):
                        column.append(value)
                    if with_ids:
                        kept.append(part)
                if kept and sum(map(len, kept)) > 1 << 22:  # a batch of long texts is passed on in parts
                    yield made(batch, owner, columns, kept)
                    owner, columns, kept = [], [[], [], [], []], []
            yield made(batch, owner, columns, kept)

    def made(batch, owner, columns, kept) -> pa.RecordBatch:
        arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
        if with_ids:
            ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            flat = np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def _pack(rows: DataFrame, shape: Shape, parts: int, number: int) -> DataFrame:
    """One round: rows with their place, and whether their sequence is settled.

    sequence_id is the round, the partition and the sequence in it. The partition's counts ride on its rows.
    """
    capacity = shape.capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("row").combine_chunks()
        buckets = table["bucket"].to_numpy()
        for bucket in np.unique(buckets).tolist():
            mine = table.filter(pa.array(buckets == bucket)) if (buckets != bucket).any() else table
            lengths = mine["length"].to_numpy()
            at, offset, made = best_fit_decreasing(lengths, capacity)
            fill = np.bincount(at, lengths, made).astype(np.int64)
            certified = made == bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            settled = np.ones(made, bool) if certified else fill == capacity
            if certified and fill.min() < capacity:
                settled[fill.argmin()] = False
            for name, kind, values in (("sequence_id", pa.int64(), at + (number << 56 | bucket << 32)), ("offset", pa.int64(), offset), ("settled", pa.bool_(), settled[at])):
                k = mine.schema.get_field_index(name)
                mine = mine.set_column(k, name, pa.array(values, kind))
            yield from mine.to_batches()

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)).cast("int"))
    return dealt.repartition(parts, "bucket").mapInArrow(run, dealt.schema)


def _parts(n: int, shape: Shape) -> int:
    return max(1, -(-n // shape.per_partition))


def pack(docs: DataFrame, path: str, shape: Shape = Shape(), text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row."""
    spark = docs.sparkSession
    all_ = materialise(pieces(docs, path, shape, text, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = _places(all_.select("row", "length"), shape)
    if places is None:
        return spark.createDataFrame([], T.StructType([*all_.drop("row").schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return all_.join(places, "row").drop("row")


def _places(rows: DataFrame, shape: Shape) -> DataFrame | None:
    """row, sequence_id and offset of rows (row, length); None if there are none."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    if not counts:
        return None
    full = rows.filter(F.col("length") == shape.capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    left = np.zeros(shape.capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n * (length < shape.capacity)
    least = bound(left, shape.capacity)
    pool = rows.filter(F.col("length") < shape.capacity).withColumns(
        {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "settled": F.lit(False)}
    )
    waiting, kept, number = int(left.sum()), 0, 1
    while waiting:
        parts = _parts(waiting, shape)
        packed = materialise(_pack(pool, shape, parts, number).drop("bucket"), f"packed-{number}")
        state = packed.groupBy("settled").agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins"))
        state = {r["settled"]: r for r in state.collect()}  # at most two rows
        settled, loose = ((state[b]["bins"], state[b]["n"]) if b in state else (0, 0) for b in (True, False))
        if loose[1] == 0 or parts == 1 or kept + settled[0] + loose[0] == least or number >= shape.rounds:
            done.append(packed)
            break
        done.append(packed.filter("settled"))
        pool = packed.filter("NOT settled")
        waiting, kept, number = loose[1], kept + settled[0], number + 1
    places = done[0].select("row", "sequence_id", "offset")
    for part in done[1:]:
        places = places.unionByName(part.select("row", "sequence_id", "offset"))
    return places


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and n_documents of every sequence of a packing made with ids; a sequence is one bounded row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.count("*").alias("n_documents"))
