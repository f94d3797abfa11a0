"""Token ids of whole texts by a word-level vocabulary, with the library called once per new piece.

Texts are cut at ASCII white space, which the vocabulary drops and never spans, and words of printable
ASCII and of the letters U+00C0 to U+017F also where its split pattern cuts; every other word stays whole.
The distinct pieces of a slice meet a bounded memory of ids per worker; the library encodes only those it
has not met. The ids are those of one call over the whole text. A tokenizer of other rules is called text
by text instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagelake.llm.tokens import byte_symbols

#: Bytes of text handled at once (a longer text is cut at white space) and distinct pieces remembered.
LIMIT = 4 << 20
REMEMBERED = 1_000_000
PART = 1 << 14

# fixed values: the rules that the cutting below stands for
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SYMBOL = byte_symbols()
_COUNT = np.arange(PART * 4, dtype=np.int32)


def cut(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the pieces, the place of each piece in them (one more at the end), and pieces before each edge."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))  # letters of two bytes that no normalisation changes
    if len(lead):
        tail = data[lead + 1]
        # the signs for times and divided by; a capital that turns to two characters
        lead = lead[~((data[lead] == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((data[lead] == 0xC4) & (tail == 0xB0))]
        kind[lead] = kind[lead + 1] = _LETTER
    solid = kind != _SPACE
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True  # a text starts a word
    first[1:-1] |= ~solid[:-1]
    where = np.flatnonzero(solid)
    data, kind, first = data[where], kind[where], first[where]
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(edges), np.int64)
    last = np.append(first[1:], True)
    # words that hold other than printable ASCII, or what may be a special string, stay whole
    odd = kind == _WHOLE
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    word = np.cumsum(first) - 1
    whole = np.zeros(word[-1] + 1, bool)
    whole[word[odd]] = True
    whole = whole[word]
    start = first | (~whole & (np.append(True, kind[1:] != kind[:-1]) | (kind == _DIGIT)))
    low = np.where(whole, data, _LOWER[data])
    quote = np.flatnonzero((data == ord("'")) & ~whole & ~last)
    quote = quote[first[quote] | (kind[quote - 1] != _OTHER)]  # inside a run of signs it is one of them
    a = low[quote + 1]
    short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    b = np.where(last[quote + 1], 0, low[np.minimum(quote + 2, n - 1)])
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for of, size in ((quote[short], 2), (quote[long], 3)):
        start[of + 1] = False
        after = of + size
        start[after[after < n]] = True
    at = np.flatnonzero(start)
    return low, np.append(at, n), np.searchsorted(at, np.searchsorted(where, edges))


class Encoder:
    """Ids of slices of texts for the vocabulary in a tokenizers .json file."""

    def __init__(self, path: str, limit: int = LIMIT, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = spec.get("normalizer") == NORMALIZER and split[0].get("pattern") == {"Regex": PATTERN} and not spec.get("post_processor")
        marked = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        self.by_pieces = known and marked
        self.limit, self.remembered = limit, remembered
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        tokenize, ids, sizes = self.library.model.tokenize, [], []
        for piece in pieces:
            if piece.isalpha() and piece.islower():  # ASCII only, nothing to normalise or to cut
                found = [t.id for t in tokenize(piece.decode())]
            else:
                text = piece.decode("utf-8", "replace")
                low = text.lower()
                if text.isalpha() and max(text) < "\u0180" and len(low) == len(text):
                    found = [t.id for t in tokenize("".join(map(_SYMBOL.__getitem__, low.encode())))]
                else:
                    found = self.library.encode(text, add_special_tokens=False).ids
            ids += found
            sizes.append(len(found))
        size = np.array(sizes, np.int32)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size, dtype=np.int32) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, np.array(ids, np.uint32))

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many stand before each edge (text i is data[edges[i]:edges[i + 1]])."""
        low, at, before = cut(data, edges)
        if len(at) == 1:
            return np.zeros(0, np.uint32), before
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(low)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.number) + len(distinct) > self.remembered:
            self.forget()
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int32, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.number), len(self.number) + len(new))
            self.learn([distinct[i] for i in new.tolist()])
        # a part of the pieces at a time, so that what is made in between stays in the processor's cache
        which, ids = pieces.indices.to_numpy(), []
        start, size = self.start[number], self.size[number]
        counts = size[which]
        for i in range(0, len(which), PART):
            n = counts[i : i + PART]
            ends = np.cumsum(n, dtype=np.int32)
            where = np.repeat(start[which[i : i + PART]] - (ends - n), n)
            where += _COUNT[: ends[-1]] if ends[-1] <= len(_COUNT) else np.arange(ends[-1], dtype=np.int32)
            ids.append(self.ids[where])
        return np.concatenate(ids), np.append(0, np.cumsum(counts))[before]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; none for a null."""
        if not self.by_pieces:
            yield from (np.array(self.library.encode(t.as_py() or "", add_special_tokens=False).ids, np.uint32) for t in column)
            return
        column = column.fill_null("").cast(pa.large_string())
        _, ends_at, payload = column.buffers()
        edges = np.frombuffer(ends_at, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(int(np.searchsorted(edges, edges[i] + self.limit, "right")) - 1, i + 1)
            if edges[j] - edges[i] > self.limit:
                yield self.long(data[edges[i] : edges[j]])
            else:
                ids, at = self.encode(data[edges[i] : edges[j]], edges[i : j + 1] - edges[i])
                yield from (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
            i = j

    def long(self, data: np.ndarray) -> np.ndarray:
        """One text beyond the limit, part by part; parts end at white space."""
        found, a = [], 0
        space = np.flatnonzero(_KIND[data] == _SPACE)
        while a < len(data):
            k = int(np.searchsorted(space, a + self.limit))
            b = int(space[k]) if k < len(space) else len(data)
            found.append(self.encode(data[a:b], np.array([0, b - a]))[0])
            a = b + 1
        return np.concatenate(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
