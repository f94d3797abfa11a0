import math
import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import index as I
from pagelake.operators import search as S
from pagelake.plans import search as P

WORDS = ["sun", "moon", "star", "sky", "sea", "tree", "rock", "fire", "wind", "rain", "the"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    docs = {i: " ".join(["the"] * rng.randint(0, 3) + rng.choices(WORDS, k=rng.randint(0, 25))) for i in range(120)}
    queries = {0: "sun moon", 1: "the", 2: "Rock, fire wind", 3: "nowhere sun", 4: "sea sea the sky", 5: "absent"}
    return docs, queries


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, queries = corpus
    return (
        spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4),
        spark.createDataFrame(list(queries.items()), "query_id long, query string"),
    )


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def brute(corpus, mode):
    docs, queries = corpus
    tokens = {d: words(t) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    out = {}
    for q, text in queries.items():
        terms = sorted(set(words(text)))
        df = {t: sum(t in tk for tk in tokens.values()) for t in terms}
        for d, tk in tokens.items():
            present = [t for t in terms if t in tk]
            if not present or (mode == "all" and len(present) < len(terms)):
                continue
            score = 0.0
            for t in present:
                idf = max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6)
                tf = tk.count(t)
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / avg))
            out[q, d] = score
    return out


def as_dict(df):
    return {(r.query_id, r.doc_id): r.score for r in df.collect()}


def brute_top(scores, k, shard=lambda d: 0):
    lists = {}
    for (q, d), s in scores.items():
        lists.setdefault((q, shard(d)), []).append((-math.floor(s * 1e6 + 0.5) / 1e6, d))
    return {(q, d, i + 1) for (q, _), v in lists.items() for i, (_, d) in enumerate(sorted(v)[:k])}


@pytest.mark.parametrize("mode", ["all", "any"])
def test_matches_equal_brute_force(corpus, tables, mode):
    got = as_dict(P.search(tables[1], tables[0], "doc_id", ["text"], match=mode))
    assert got == pytest.approx(brute(corpus, mode), abs=1e-6)


@pytest.mark.parametrize("plain_rows", [0, 10**9])
@pytest.mark.parametrize("shards", [1, 3])
def test_top_any_is_exact_on_both_paths(corpus, tables, plain_rows, shards):
    parsed = S.parse(tables[1])
    hits = I.scan_hits(tables[0], "doc_id", I.tokens_of(["text"]), S.terms_of(parsed))
    shard = (F.col("doc_id") % shards) if shards > 1 else None
    got = S.top_any(parsed, hits, 4, shard=shard, n_shards=shards, plain_rows=plain_rows, slack=1)
    want = brute_top(brute(corpus, "any"), 4, lambda d: d % shards)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == want


def test_shard_lists_merge_into_the_global_list(corpus, tables):
    found = P.search(tables[1], tables[0], "doc_id", ["text"], match="any").drop("n_matched")
    per_shard = S.top_per_shard(found, F.col("doc_id") % 3, 4)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in per_shard.collect()} == brute_top(brute(corpus, "any"), 4, lambda d: d % 3)
    merged = S.merge_shards(per_shard, 4)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in merged.collect()} == brute_top(brute(corpus, "any"), 4)


def test_stored_index_gives_the_same(corpus, tables, spark, tmp_path):
    I.write_index(tables[0], "doc_id", ["text"], str(tmp_path / "i"))
    parsed = S.parse(tables[1])
    got = as_dict(S.match_all(parsed, I.read_hits(spark, str(tmp_path / "i"), S.terms_of(parsed))))
    assert got == pytest.approx(brute(corpus, "all"), abs=1e-6)


def test_phrase_and_exclusion(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b a c"), (3, "a a b"), (4, "a b x")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a b", ["x"])], "query_id long, query string, bad array<string>")
    parsed = S.parse(q)
    hits = I.scan_hits(docs, "doc_id", I.tokens_of(["text"]), S.terms_of(parsed, "terms", "bad"), positions=True)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(S.match_all(parsed, hits, phrase="phrase")) == [1, 3, 4]
    assert ids(S.match_all(parsed, hits, none_of="bad")) == [1, 2, 3]
    assert ids(S.match_all(parsed, hits, phrase="phrase", none_of="bad")) == [1, 3]


def test_pages_and_envelope(corpus, tables):
    found = P.search(tables[1], tables[0], "doc_id", ["text"], match="any").drop("n_matched")
    first, second = S.page_of(found, 1, 5), S.page_of(found, 2, 5)
    got = {(r.query_id, r.doc_id, r["rank"]) for r in first.unionByName(second).collect()}
    assert got == brute_top(brute(corpus, "any"), 10)
    assert S.envelope(first, "sun", "all", 1).columns[:3] == ["query", "category", "page"]
    with pytest.raises(ValueError):
        S.envelope(first, "")
    with pytest.raises(ValueError):
        S.page_of(found, 0)


def test_excerpt_window(spark):
    title = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(title, ["w20", "w22", "zz"]), ("Short, one", ["short"]), ("", ["a"])], "t string, terms array<string>")
    got = [r.e for r in df.select(S.excerpt(F.col("t"), F.col("terms"), 16).alias("e")).collect()]
    # the earliest window that holds both hits starts at word 7
    want = " ".join(f"<b>w{i}</b>" if i in (20, 22) else f"w{i}" for i in range(7, 23))
    assert got[0] == "..." + want + "..."
    assert got[1] == "<b>Short,</b> one"
    assert got[2] == ""


def test_suggestions(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "alphabet soup"), (3, "beta max")], "page_id long, title string")
    q = spark.createDataFrame([("x", "alph"), ("y", "alpha be"), ("z", "a")], "query_id string, query string")
    got = sorted((r.query_id, r.doc_id) for r in P.suggest(q, docs, "page_id").collect())
    assert got == [("x", 1), ("x", 2), ("y", 1)]


def test_search_plans_have_no_cross_join(tables):
    from helpers import plan

    found = P.search_top(tables[1], tables[0], "doc_id", ["text"], 10, match="any")
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
