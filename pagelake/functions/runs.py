"""Term runs of many texts at once, in Arrow batches.

The texts are tokens with spaces between them (``text.spaced_tokens``). A batch is cut into words, and one
stable sort by (row, term) puts the occurrences of a term in a text side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Runs(NamedTuple):
    """Per run its row, term and count, and where its places begin; ``dl`` is the number of tokens of each row."""

    row: np.ndarray
    term: pa.Array
    tf: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    dl: np.ndarray

    def positions(self) -> pa.Array:
        ends = np.append(self.starts, len(self.places)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(self.places))


def text_slices(batches: Iterable[pa.RecordBatch], text: str, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``chars`` bytes of text each, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        at = (np.cumsum(sizes) - sizes) // chars
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def runs(texts: pa.Array, only: pa.Array | None = None) -> Runs:
    """Runs of each text, ordered by row and term (in byte order); nulls have none.

    With ``only`` the runs of these terms; places and lengths count all tokens.
    """
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    row = np.asarray(pc.list_parent_indices(split), np.int64)
    words = split.flatten()
    real = np.asarray(pc.not_equal(words, "")).astype(bool)
    words, row = words.filter(pa.array(real)), row[real]
    dl = np.bincount(row, minlength=len(texts)).astype(np.int64)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)).astype(np.int32)
    coded = words.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = np.asarray(coded.indices, np.int64)
    if only is not None:
        kept = np.asarray(pc.is_in(coded.dictionary, only)).astype(bool)[codes]
        codes, row, place = codes[kept], row[kept], place[kept]
    key = row * max(len(order), 1) + rank[codes]
    by = np.argsort(key, kind="stable")
    key = key[by]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    first = by[starts]
    tf = np.diff(np.append(starts, len(key))).astype(np.int64)
    return Runs(row[first], coded.dictionary.take(pa.array(codes[first])), tf, starts, place[by], dl)
