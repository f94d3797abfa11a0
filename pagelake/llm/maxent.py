"""Language model scores: a hashed maximum-entropy model with class-factored softmax.

Tokens are lower-cased (A-Z) words and one end per text. The probability of a token is a product of
choices among sixteen: of its class, of a class within that, and of the word. The most frequent
15 * 256 words have such a path, by frequency; all others share one class and are drawn in it by
add-one unigram counts, with one place for an unseen word, so all probabilities sum to one. Each
choice is a softmax of a bias (the log share of the branch in the counts) and of weights hashed from
the history: previous word, previous two, and the words two and three back (skips). A history and a
node share one row of sixteen weights in a table of ``2^bits`` rows.

Training is in ``rounds``: every round reads another part of the training texts (each text is read in
one round), all tasks sum the gradient and the curvature of their tokens for every weight, Spark adds
the sums chunk by chunk, and the weights move by the damped quotient. Counts cover all training
texts. Scoring is one narrow pass in sparse numpy batches: only rows of present histories are read.

Bounded by the shape, not by the corpus: the weight table, the paths and at most ``head`` of the
most frequent words, whose counts go to all tasks. Counts of all other words stay distributed; tokens outside the
head meet them by a join on the word, after adding up within each text. Words are known by 64-bit hashes.

A null text is an empty one: its only token is the end. A null id is in no held-out fold. Rows that
repeat are trained and scored as often as they come. Without training texts every token is unseen
(base and score are equal). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import fold, mix, slices, split_words, word_hashes
from pagelake.sources.store import materialise

BRANCH = 16
END = np.uint64(0x1F83D9ABFB41BD6B)
_NONE = np.uint64(0x5BE0CD19137E2179)
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_NODE = np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 12
_SLICE = 1 << 18  # bytes of text read at once, and
_BLOCK = 1 << 13  # tokens whose branches are weighed at once: their numbers stay in a core's cache


class Shape(NamedTuple):
    """log2 of weight rows, words in the head, rounds, damping, prior curvature."""

    bits: int = 15
    head: int = 1 << 19
    rounds: int = 3
    damping: float = 0.3
    prior: float = 50.0


class Vocabulary(NamedTuple):
    """Head words sorted by hash with their counts and paths (-1: in the shared class), and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    paths: np.ndarray
    bias: np.ndarray
    tokens: int
    distinct: int
    rest_tokens: int
    rest_distinct: int


class Text(NamedTuple):
    """Tokens of a slice, the first token of each row, and the hashed histories."""

    tokens: np.ndarray
    first: np.ndarray
    histories: np.ndarray


def read(column: pa.Array) -> Text:
    words = split_words(column)
    hashes = word_hashes(words, lower=True)
    tokens = np.insert(hashes, words.first[1:], END)
    first = words.first + np.arange(len(words.first))
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    back = [np.where(place >= k, np.concatenate((np.full(k, _NONE), tokens[:-k]))[: len(tokens)], _NONE) for k in (1, 2, 3)]
    histories = np.stack([mix(back[0] ^ _SALT[0]), mix(mix(back[1] ^ _SALT[1]) + back[0]), mix(back[1] ^ _SALT[2]), mix(back[2] ^ _SALT[3])])
    return Text(tokens, first, histories)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return all_, np.bincount(inverse, np.concatenate(counts), len(all_)).astype(np.int64)


def count_words(docs: DataFrame, held: int = 1 << 20) -> DataFrame:
    """word (hash) and n over all rows; tasks add up about ``held`` distinct words before they send them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        waiting = 0

        def send() -> pa.RecordBatch:
            h, c = _merged(hashes, counts)
            hashes[:], counts[:] = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["word", "n"])

        for batch in slices(batches, limit=_SLICE):
            h, c = np.unique(read(batch.column("text")).tokens, return_counts=True)
            hashes.append(h)
            counts.append(c)
            waiting += len(h)
            if waiting > 2 * held:
                h, c = _merged(hashes, counts)
                hashes[:], counts[:], waiting = [h], [c], len(h)
                if waiting > held:
                    yield send()
                    waiting = 0
        yield send()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """The head (at most ``shape.head`` words), the paths of its most frequent words and the biases."""
    totals = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # the head ends at a step of the counts, so that it needs no sorting across tasks
    step = F.floor(F.log2("n") * 64).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # at most 64 * 63 rows
    kept, least = 0, 1 << 30
    for r in sorted(steps, reverse=True):
        if kept + r["words"] > shape.head:
            break
        kept, least = kept + r["words"], r["step"]
    top = counts.filter(step >= least).select("word", "n").toArrow()
    hashes, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    own = min(len(n), (BRANCH - 1) * BRANCH * BRANCH)
    paths = np.full(len(n), -1, np.int32)
    paths[:own] = BRANCH * BRANCH + np.arange(own)  # branch 0 of the first choice is the shared class
    rest = totals["n"] - int(n[:own].sum())
    mass = np.zeros(BRANCH**3)
    mass[paths[:own]] = n[:own]
    levels = [mass.reshape(BRANCH, -1).sum(1), mass.reshape(BRANCH**2, -1).sum(1), mass]
    levels[0][0] = rest + totals["v"] - own + 1  # add-one counts of the shared class and one unseen word
    # a branch without words must never be chosen; one of the paths' leaves always has some
    bias = np.concatenate([np.log(np.maximum(x, 1e-30) / np.maximum(x.reshape(-1, BRANCH).sum(1), 1e-30).repeat(BRANCH)) for x in levels]).reshape(-1, BRANCH)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], n[order], paths[order], bias, totals["n"], totals["v"], rest, totals["v"] - own)


def lookup(tokens: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Count (0 outside the head) and path of each token."""
    if not len(vocab.hashes):
        return np.zeros(len(tokens), np.int64), np.full(len(tokens), -1, np.int32)
    order = np.argsort(tokens)  # ascending tokens walk through the head once
    at = np.empty(len(tokens), np.int64)
    at[order] = np.searchsorted(vocab.hashes, tokens[order])
    at = np.minimum(at, len(vocab.hashes) - 1)
    found = vocab.hashes[at] == tokens
    return np.where(found, vocab.counts[at], 0), np.where(found, vocab.paths[at], -1)


def choices(text: Text, paths: np.ndarray, bits: int, part: slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: positions, node (row of the biases), branch taken and weight rows of the histories."""
    p = paths[part]
    at = np.arange(len(p))
    known = np.flatnonzero(p >= 0)
    first = np.where(p >= 0, p // BRANCH**2, 0)
    for where, node, branch in (
        (at, np.zeros(len(p), np.int64), first),
        (known, 1 + p[known] // BRANCH**2, p[known] // BRANCH % BRANCH),
        (known, 1 + BRANCH + p[known] // BRANCH, p[known] % BRANCH),
    ):
        if len(where):
            salted = text.histories[:, part][:, where] ^ (node.astype(np.uint64) * _NODE)
            yield where, node, branch, ((salted * _NODE) >> np.uint64(64 - bits)).astype(np.int64)


def soften(node: np.ndarray, rows: np.ndarray, bias: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sixteen branches (one row each) the logits below their largest, the exponentials of these, and their sums."""
    z = bias.take(node, 0)
    for r in rows:
        z += weights.take(r, 0)
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    e = np.exp(z)
    return z, e, e.sum(0)


def token_scores(text: Text, paths: np.ndarray, vocab: Vocabulary, weights: np.ndarray, bits: int, block: int = _BLOCK) -> np.ndarray:
    """Natural log probability of the path of each token (within the shared class: of the class)."""
    out = np.zeros(len(paths))
    for a in range(0, len(paths), block):
        part = slice(a, min(a + block, len(paths)))
        for where, node, branch, rows in choices(text, paths, bits, part):
            z, _, total = soften(node, rows, vocab.bias, weights)
            out[a + where] += z[branch, np.arange(len(where))] - np.log(total)
    return out


def add_slopes(text: Text, paths: np.ndarray, vocab: Vocabulary, weights: np.ndarray, bits: int, g: np.ndarray, h: np.ndarray, block: int = 2 * _BLOCK) -> None:
    """Add gradient and curvature of the tokens to ``g`` and ``h``, which have a row for each branch."""
    for a in range(0, len(paths), block):
        for _, node, branch, rows in choices(text, paths, bits, slice(a, min(a + block, len(paths)))):
            _, p, total = soften(node, rows, vocab.bias, weights)
            p /= total
            curve = p * (1 - p)
            np.negative(p, out=p)
            p[branch, np.arange(len(branch))] += 1
            at, each = rows.ravel(), np.empty(rows.shape)
            for sums, x in ((g, p), (h, curve)):
                for k in range(BRANCH):
                    each[:] = x[k]  # every history's row gets the same numbers
                    sums[k] += np.bincount(at, each.ravel(), sums.shape[1])


def _slopes(docs: DataFrame, vocab, weights, shape: Shape) -> DataFrame:
    """chunk, part, g and h: a task's sums of gradient and curvature, as chunks of doubles."""
    size = (1 << shape.bits) * BRANCH

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, w = vocab.value, weights.value
        g, h, seen = np.zeros((BRANCH, 1 << shape.bits)), np.zeros((BRANCH, 1 << shape.bits)), False
        for batch in slices(batches, limit=_SLICE):
            text = read(batch.column("text"))
            _, paths = lookup(text.tokens, voc)
            add_slopes(text, paths, voc, w, shape.bits, g, h)
            seen = True
        if seen:
            n = size // _CHUNK
            flat = [x.T.astype(np.float32).ravel() for x in (g, h)]
            made = [pa.array([x[i * _CHUNK : (i + 1) * _CHUNK].tobytes() for i in range(n)], pa.binary()) for x in flat]
            part = pa.array([TaskContext.get().partitionId() % 64] * n, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), part, *made], ["chunk", "part", "g", "h"])

    return docs.select("text").mapInArrow(run, "chunk int, part int, g binary, h binary")


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(b.as_py(), np.float32).astype(np.float64) for b in table[c]).astype(np.float32).tobytes() for c in ("g", "h")]
        return pa.table({"chunk": table["chunk"][:1], "part": table["part"][:1], "g": pa.array([sums[0]], pa.binary()), "h": pa.array([sums[1]], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, "chunk int, part int, g binary, h binary")


def train(docs: DataFrame, vocab: Vocabulary, shape: Shape) -> np.ndarray:
    """Weights of shape (2^bits, 16) from the texts of ``docs``, each read in one round."""
    context = docs.sparkSession.sparkContext
    weights = np.zeros(((1 << shape.bits) * BRANCH,), np.float32)
    shared = context.broadcast(vocab._replace(hashes=vocab.hashes[vocab.paths >= 0], counts=vocab.counts[vocab.paths >= 0], paths=vocab.paths[vocab.paths >= 0]))
    turn = F.pmod(F.xxhash64("text"), F.lit(shape.rounds))
    for i in range(shape.rounds):
        now = context.broadcast(weights.reshape(-1, BRANCH).astype(np.float64))
        sums = _added(_added(_slopes(docs.filter(turn == i), shared, now, shape), "chunk", "part"), "chunk").collect()
        for r in sums:  # as many rows as the table has chunks
            at = slice(r["chunk"] * _CHUNK, (r["chunk"] + 1) * _CHUNK)
            g, h = np.frombuffer(r["g"], np.float32), np.frombuffer(r["h"], np.float32)
            weights[at] += shape.damping * g / (h + shape.prior)
        now.unpersist()
    shared.unpersist()
    return weights.reshape(-1, BRANCH).astype(np.float64)


def _scored(docs: DataFrame, vocab, weights, shape: Shape) -> DataFrame:
    """Each row's sums over tokens of the head, and its other tokens as (word, times)."""
    kind = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, w = vocab.value, weights.value
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=_SLICE):
            text = read(batch.column("text"))
            counts, paths = lookup(text.tokens, voc)
            logs = np.log10(counts + 1.0)
            shared = paths < 0
            by_row = np.repeat(np.arange(batch.num_rows), np.diff(text.first))
            add = lambda x: np.bincount(by_row, x, batch.num_rows)
            score = add(token_scores(text, paths, voc, w, shape.bits)) / np.log(10) + add(np.where(shared, logs, 0.0))
            score -= add(shared) * np.log10(voc.rest_tokens + voc.rest_distinct + 1.0)
            n = np.diff(text.first)
            base = add(logs) - n * np.log10(voc.tokens + voc.distinct + 1.0)
            far = np.flatnonzero(counts == 0)
            key = np.stack((by_row[far].astype(np.uint64), text.tokens[far])) if len(far) else np.zeros((2, 0), np.uint64)
            order = np.lexsort(key[::-1])
            key = key[:, order]
            new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))) if len(far) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((new, [len(far)]))) if len(far) else new
            sizes = np.concatenate(([0], np.cumsum(np.bincount(key[0, new].astype(np.int64), minlength=batch.num_rows))))
            items = pa.StructArray.from_arrays([pa.array(key[1, new].view(np.int64)), pa.array(times, pa.int64())], ["word", "times"])
            made = [batch.column("doc_id"), batch.column("held_out"), pa.array(number + np.arange(batch.num_rows)), pa.array(n, pa.int64())]
            made += [pa.array(add(counts > 0).astype(np.int64)), pa.array(base), pa.array(score)]
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items).cast(kind)], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "own", "far"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_kind}, held_out boolean, row long, n_tokens long, known long, base double, own double, far array<struct<word: long, times: long>>")


def scores(docs: DataFrame, shape: Shape = Shape(), divisor: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    marked = docs.select("doc_id", "text", fold(docs, divisor, held).alias("held_out"))
    training = marked.filter("NOT held_out")
    counts = materialise(count_words(training), "words")
    vocab = vocabulary(counts, shape)
    weights = train(training, vocab, shape)
    context = docs.sparkSession.sparkContext
    rows = materialise(_scored(marked, context.broadcast(vocab), context.broadcast(weights), shape), "scored")
    # tokens outside the head: their counts come by a join, added up per row before and after
    met = rows.select("row", F.inline("far")).join(counts, "word")
    found = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.drop("far").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("own") + logs).alias("score"),
    )
