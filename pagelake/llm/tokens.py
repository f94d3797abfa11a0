"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

A text is cut at the special strings (one token each, as the library does by default) and by the
vocabulary's split pattern. In each piece the adjacent pair of lowest rank is merged, leftmost
first, until no ranked pair is left: tokens = first symbols minus merges. A piece of n bytes takes
n log n steps, so one endless word does no harm. Counts of pieces are remembered per worker in two
generations of bounded dictionaries.

Null and empty texts count 0. Rows with a null or repeated id are counted like any other.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 500_000
#: Unicode White_Space, which the split pattern's \s stands for.
_BLANK = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PieceCounts(dict):
    """Tokens of a piece; computed on the first use and remembered in bounded memory.

    A symbol is a number: a byte is itself, the result of merge r is 256 + r (or the number the same
    string got first). A heap entry is ``rank << 32 | position``, so the leftmost of the lowest pairs
    comes first; an entry whose pair has changed meanwhile is recognised by its rank and skipped.
    """

    def __init__(self, merges: Iterable[tuple[str, str]], remembered: int = REMEMBERED):
        super().__init__()
        number = {s: b for b, s in enumerate(byte_symbols())}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(merges):
            self.ranks.setdefault(number[left] << 24 | number[right], rank)
            self.made.append(number.setdefault(left + right, 256 + rank))
        self.remembered, self.older = remembered, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        n = self.older.get(piece)
        if n is None:
            n = self.merged(piece.encode("utf-8", "surrogatepass"))
        if len(piece) < 64:
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        rank_of, made = self.ranks.get, self.made
        part = [*piece, -1]
        n = len(piece)
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(part[i] << 24 | part[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j, left = after[i], part[i]
            if left < 0 or j >= n or rank_of(left << 24 | part[j]) != rank:
                continue
            merges += 1
            part[i] = symbol = made[rank]
            part[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(symbol << 24 | part[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(part[h] << 24 | symbol)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges


class TokenCounter:
    """Counts the tokens of texts for a byte-level vocabulary in a tokenizers .json file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.pieces = PieceCounts(pairs)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        explicit = pattern.replace(r"[^\s", f"[^{_BLANK}").replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]")
        self.find = regex.compile(explicit).findall

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        count, pieces = 0, self.pieces.__getitem__
        parts = [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            count = len(parts) - 1
        return count + sum(sum(map(pieces, self.find(p))) for p in parts)


_counters: dict[tuple[str, str], TokenCounter] = {}


def counter(path: str, pattern: str) -> TokenCounter:
    """One counter per worker and vocabulary."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = TokenCounter(path, pattern)
    return _counters[path, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; one narrow stage without shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select("doc_id", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
