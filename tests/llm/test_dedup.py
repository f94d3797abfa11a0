import random

import numpy as np
import pytest

from pagelake.llm import neardup, superkmer
from pagelake.llm.components import components

from . import brute

SCHEMA = "doc_id long, text string, lang string, key long, n int, band long, runs string"


def docs_of(spark, texts):
    return spark.createDataFrame([(d, t, "en", 1, 2, 3, "x") for d, t in texts], SCHEMA)


def texts_with_copies(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeE") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(70)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.3:
            w = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.randint(0, 6)):
                if w:
                    w[r.randrange(len(w))] = word()
            out.append((i, " ".join(w)))
        elif kind < 0.45:
            w = [word() for _ in range(r.randint(0, 40))]
            out.append((i, " ".join(w + passage[r.randint(0, 15) :] + [word() for _ in range(r.randint(0, 30))])))
        elif kind < 0.5:
            out.append((i, r.choice([None, "", " \t\n", "A", "a b", "a  b", "A\x0bB c"])))
        else:
            out.append((i, r.choice([" ", "\n", "\t "]).join(word() for _ in range(r.randint(1, 200)))))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, seed, shingle, percent):
    texts = texts_with_copies(seed)
    got = neardup.near_duplicates(docs_of(spark, texts), neardup.Shape(shingle=shingle, percent=percent)).collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(texts, shingle, percent)


def test_near_duplicates_of_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = neardup.near_duplicates(docs, neardup.Shape(shingle=3, percent=85)).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == brute.near_duplicates(texts, 3, 85)


def test_chains_reach_the_smallest_id_and_blocks_are_whole(spark, monkeypatch):
    """A chain of texts, each like the next only, in many small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    w = [f"w{i}" for i in range(400)]
    texts = [(100 - i, " ".join(w[i * 5 : i * 5 + 120])) for i in range(30)]
    texts += [(200 + i, texts[0][1]) for i in range(20)]
    got = neardup.near_duplicates(docs_of(spark, texts), neardup.Shape(shingle=3, percent=85)).collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(texts, 3, 85)


def test_near_duplicates_without_rows_and_with_null_or_repeated_ids(spark):
    shape = neardup.Shape()
    assert neardup.near_duplicates(docs_of(spark, []), shape).count() == 0
    got = neardup.near_duplicates(docs_of(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (3, "a b"), (9, None)]), shape).collect()
    assert sorted(map(str, (r[2] for r in got))) == ["3", "3", "3", "9", "None"]
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate((a[:700], r.integers(0, 1 << 63, 200).astype(np.uint64)))
    same = np.mean([neardup.signature(a + np.uint64(i), 256) == neardup.signature(b + np.uint64(i), 256) for i in range(40)])
    assert abs(same - 700 / 1100) < 0.02
    few = neardup.signature(a[:1], 256)
    assert sorted(few >> np.uint64(48)) == list(range(256))  # one shingle gives each slot a rank of its own


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 100), (5, 5), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 90}


@pytest.mark.parametrize("crowd", [0, 3, 256])
def test_repeated_words_equal_brute_force(spark, crowd):
    texts = texts_with_copies(3, 150)
    got = superkmer.repeated_words(docs_of(spark, texts), superkmer.Shape(20, 8, crowd)).drop("key").collect()
    assert sorted(map(tuple, got)) == brute.repeated_words(texts, 20)


def test_repeated_words_of_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = superkmer.repeated_words(docs).drop("key").collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == brute.repeated_words(texts, 50)


def test_kept_text_long_words_and_odd_ids(spark):
    w = " ".join(f"w{i}" for i in range(60))
    texts = [(1, w), (2, "x " + w + " y"), (2, "x " + w + " y"), (3, w), (None, w), (4, "z" * 300_000), (5, "ab " * 50_000), (6, None)]
    got = superkmer.repeated_words(docs_of(spark, texts), with_text=True).collect()
    by = {(r.doc_id, r.n_words): (r.n_removed, r.left_text) for r in got}
    assert len(got) == len(texts)
    assert by[(2, 62)] == (60, "x y") and by[(3, 60)] == (60, "") and by[(None, 60)] == (0, None) and by[(1, 60)] == (0, None)
    assert by[(5, 50_000)] == (0, None)  # repeats inside one document are not an earlier document
    assert superkmer.repeated_words(docs_of(spark, [])).count() == 0
