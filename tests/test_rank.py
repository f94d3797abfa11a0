import math
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagelake.config import DEFAULT
from pagelake.operators import rank as R


def brute_cosine(contents, query, cap=10_000):
    texts = [*contents, query]
    counts = [Counter(w for w in t.lower().split() if len(w) > 1) for t in texts]
    total = sum(counts, Counter())
    kept = sorted(total, key=lambda t: (-total[t], t))[:cap]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in c for c in counts))) + 1 for t in kept}
    vec = [{t: c[t] * idf[t] for t in kept if c[t]} for c in counts]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    return [
        sum(v[t] * vec[-1].get(t, 0) for t in v) / (n * norm[-1]) if n and norm[-1] else 0.0
        for v, n in zip(vec[:-1], norm[:-1])
    ]


CONTENTS = ["cats dogs dogs fish", "dogs fish fish fish", "", "zebra yak x"]


@pytest.mark.parametrize("cap", [10_000, 2])
def test_cosine(spark, cap):
    hits = spark.createDataFrame([(0, i, "title", c) for i, c in enumerate(CONTENTS)], "query_id long, doc_id long, title string, content string")
    queries = spark.createDataFrame([(0, "dogs cats"), (1, "unused")], "query_id long, query string")
    got = {r.doc_id: r.similarity for r in R.tfidf_cosine(hits, queries, replace(DEFAULT, max_vocabulary=cap)).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(brute_cosine(CONTENTS, "dogs cats", cap), abs=1e-12)


def test_cosine_uses_titles_when_no_hit_has_content(spark):
    hits = spark.createDataFrame([(0, 1, "dogs", ""), (0, 2, "cats", None)], "query_id long, doc_id long, title string, content string")
    queries = spark.createDataFrame([(0, "dogs")], "query_id long, query string")
    got = {r.doc_id: r.similarity for r in R.tfidf_cosine(hits, queries).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}


def test_overlap_counts_substrings(spark):
    df = spark.createDataFrame([("cat dog", "Cats", "run"), ("", "a", "b"), ("cat cat", "x", "CAT")], "q string, t string, c string")
    got = [r.o for r in df.select(R.word_overlap(F.col("q"), F.col("t"), F.col("c")).alias("o")).collect()]
    assert got == [0.5, 0.0, 1.0]


def test_freshness(spark):
    as_of = "2024-12-31 12:00:00"
    days = [0, 100, 200, -10]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d int")
    then = F.to_timestamp(F.lit(as_of))
    at = F.timestamp_seconds(F.unix_timestamp(then) - F.col("d") * 86400)
    got = [r.f for r in df.select(R.freshness(at, then).alias("f")).collect()]
    assert got == pytest.approx([1.0, 265 / 365, 0.5, 375 / 365, 1.0])


def test_composite_order_and_defaults(spark):
    hits = spark.createDataFrame(
        [(0, 1, "u", 0.5, None, 0.76, 3), (0, 2, "v", 0.0, None, None, 1), (0, 3, "w", 0.0, None, None, 2)],
        "query_id long, doc_id long, url string, similarity double, crawled_at timestamp, safety double, input_rank long",
    )
    shares = spark.createDataFrame([("u", 0.2)], "to_url string, share double")
    scored = R.score_hits(hits, shares, F.current_timestamp())
    got = R.sort_hits(scored).collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, pytest.approx(0.486)), (2, pytest.approx(0.2)), (3, pytest.approx(0.2))]
    assert [r.doc_id for r in R.top_hits(scored, 2).orderBy("rank").collect()] == [1, 2]


def test_learned_ranker(spark):
    rows = [(i, i / 100, 0.0, 1.0, 1.0, float(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, similarity double, share double, freshness double, safety double, label double")
    model = R.train_ranker(df, "label", replace(DEFAULT, forest_trees=5))
    out = {r.doc_id: r.prediction for r in R.predict(df, model).collect()}
    assert out[5] < 0.3 < 0.7 < out[95]
    gaps = df.withColumn("share", F.lit(None).cast("double"))
    assert {r.prediction for r in R.predict(gaps, model).collect()} == {0.5}
    assert {r.prediction for r in R.predict(df, None).collect()} == {0.5}
