"""Words and their hashes for whole Arrow text columns, computed with numpy inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+``: only ASCII white space separates them. A null text has none.
Memory per call is about sixty times the bytes of the slice, and a slice holds at most
``SLICE_BYTES`` of text plus one document, so it is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > SLICE_BYTES * 8:  # a very long text: its table is not kept
            return have[:n]
        _powers[base] = have
    return have[:n]


class Words(NamedTuple):
    """Bytes of a column; word i is ``data[starts[i]:ends[i]]``, row r owns words first[r]:first[r+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = np.maximum(size - 1, 0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(column: pa.Array) -> Words:
    column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    _, ends_at, payload = column.buffers()
    offsets = np.frombuffer(ends_at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(payload, np.uint8)[offsets[0] : offsets[-1]] if payload is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    here = solid[1:-1]
    starts = np.flatnonzero(here & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(here & (~solid[2:] | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes anywhere."""
    n = len(words.data)
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[words.data] if lower else words.data] * _power(_ODD, n), out=total[1:])
    value = (total[words.ends] - total[words.starts]) * _power(_ODD_INVERSE, n)[words.starts]
    return mix(value + (words.ends - words.starts).astype(np.uint64) * _STEP)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = hashes[:n].copy()
    for i in range(1, k):
        value *= np.uint64(_ODD)
        value += hashes[i : n + i]
    return mix(value + np.uint64(k))


def fold(df: DataFrame, divisor: int, remainder: int, key: str = "doc_id"):
    """Whether crc32 of the key as text leaves the remainder; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor == remainder, F.lit(False))
