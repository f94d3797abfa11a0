"""Relevance ranking of search hits."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import half_up, inline_rows
from pagelake.functions import text as T
from pagelake.operators.ranked import top_per_group
from pagelake.sources.store import broadcast_if_small, materialise

FEATURES = ("similarity", "share", "freshness", "safety")


def _ranking_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(T.KEYWORD_TOKEN % 2), F.lit(0))
    return T.without_stop_words(words, T.stop_words(("english",)))


def _counted(text: Column, field: str) -> Column:
    runs = T.term_runs(_ranking_tokens(F.coalesce(text, F.lit(""))))
    return F.transform(
        runs, lambda r: F.struct(F.lit(field).alias("field"), r["term"].alias("term"), r["tf"].alias("tf"))
    )


def tfidf_cosine(hits: DataFrame, queries: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(query_id, doc_id, similarity) of each hit with its query.

    ``hits``: (query_id, doc_id, title, content); ``queries``: (query_id, query). The
    query is one more document of its own corpus. Contents are compared, or titles
    where a query's hits have no content at all. All terms count unless ``max_vocabulary``
    keeps the most frequent ones of each query. Vectors stay as (query, document,
    term, tf) rows: texts are read once, and each document counts its terms in place.
    """
    filled = F.coalesce(F.col("content"), F.lit("")) != ""
    # one row stands for the document itself, so hits without terms are kept
    itself = F.array(F.struct(F.lit("itself").alias("field"), F.lit("").alias("term"), filled.cast("long").alias("tf")))
    parts = F.concat(itself, _counted(F.col("content"), "content"), _counted(F.col("title"), "title"))
    doc_rows = inline_rows(hits, ["query_id", F.col("doc_id").cast("long").alias("doc_id")], parts, "field")
    query_rows = inline_rows(
        queries, ["query_id", F.lit(None).cast("long").alias("doc_id")], _counted(F.col("query"), "query"), "field"
    )
    tf = materialise(doc_rows.unionByName(query_rows), "tfidf")

    docs = tf.filter("field = 'itself'").select("query_id", "doc_id", "tf")
    per_query = docs.groupBy("query_id").agg(
        (F.count("*") + 1).alias("n"),
        F.when(F.max("tf") > 0, F.lit("content")).otherwise(F.lit("title")).alias("compared"),
    )
    used = tf.join(broadcast_if_small(per_query), "query_id").filter((F.col("field") == "query") | (F.col("field") == F.col("compared")))
    vocabulary = materialise(
        used.groupBy("query_id", "term", "n").agg(
            F.sum("tf").alias("total"),
            F.count("*").alias("df"),
            F.coalesce(F.max(F.when(F.col("field") == "query", F.col("tf"))), F.lit(0)).alias("query_tf"),
        ),
        "vocabulary",
    )
    if cfg.max_vocabulary is not None:
        vocabulary = top_per_group(
            vocabulary, ["query_id"], [F.desc("total"), F.asc("term")], cfg.max_vocabulary, "term"
        )
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weights = vocabulary.select("query_id", "term", idf.alias("idf"), (F.col("query_tf") * idf).alias("qw"))
    query_norm = weights.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    w = F.col("tf") * F.col("idf")
    dots = (
        used.filter("field <> 'query'")
        .select("query_id", "doc_id", "term", "tf")
        .join(weights, ["query_id", "term"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum(w * F.col("qw")).alias("dot"), F.sqrt(F.sum(w * w)).alias("dn"))
        .join(query_norm, "query_id")
    )
    length = F.col("dn") * F.col("qn")
    similarity = dots.select(
        "query_id", "doc_id", F.when(length > 0, F.col("dot") / length).otherwise(F.lit(0.0)).alias("similarity")
    )
    return (
        docs.select("query_id", "doc_id")
        .join(similarity, ["query_id", "doc_id"], "left")
        .select("query_id", "doc_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    )


def word_overlap(query: Column, title: Column, content: Column) -> Column:
    """Share of the distinct query words that occur anywhere in title and content."""
    words = F.array_distinct(T.words(F.lower(query)))
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return found / F.greatest(F.size(words), F.lit(1))


def freshness(crawled_at: Column, as_of: Column, cfg: Settings = DEFAULT) -> Column:
    """1 on the first day, falling to the minimum; 1 without a date."""
    micros = F.unix_micros(as_of) - F.unix_micros(crawled_at)
    days = F.floor(micros / F.lit(86_400_000_000))
    fresh = F.greatest(F.lit(cfg.min_freshness), F.lit(1.0) - days / F.lit(cfg.freshness_days))
    # greatest() skips nulls, so a missing date is tested on its own
    return F.when(days.isNull(), F.lit(1.0)).otherwise(fresh)


def composite(similarity: Column, share: Column, fresh: Column, safety: Column, cfg: Settings = DEFAULT) -> Column:
    return (
        cfg.weight_similarity * similarity
        + cfg.weight_share * F.coalesce(share, F.lit(0.0))
        + cfg.weight_freshness * fresh
        + cfg.weight_safety * F.coalesce(safety, F.lit(1.0))
    )


def score_hits(hits: DataFrame, shares: DataFrame, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Composite score of hits.

    ``hits``: (query_id, doc_id, url, similarity, crawled_at, safety, input_rank);
    ``shares``: (to_url, share).
    """
    wanted = shares.select(F.col("to_url").alias("url"), "share")
    fresh = freshness(F.col("crawled_at"), as_of, cfg)
    score = composite(F.col("similarity"), F.col("share"), fresh, F.col("safety"), cfg)
    return hits.join(wanted, "url", "left").withColumn("score", half_up(score))


def sort_hits(scored: DataFrame) -> DataFrame:
    """Best first within each query; equal scores keep their input order."""
    return scored.orderBy("query_id", F.desc("score"), "input_rank")


def top_hits(scored: DataFrame, k: int) -> DataFrame:
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("input_rank")], k, "doc_id")


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip").transform(df)


def train_ranker(labelled: DataFrame, label: str, cfg: Settings = DEFAULT) -> RandomForestRegressionModel:
    """Forest over (similarity, share, freshness, safety)."""
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=cfg.forest_trees, seed=cfg.forest_seed,
        featureSubsetStrategy="all",
    )
    return forest.fit(assemble(labelled))


def predict(df: DataFrame, model: RandomForestRegressionModel | None) -> DataFrame:
    """Add ``prediction``; without a model or with missing features it is neutral, 0.5."""
    if model is None:
        return df.withColumn("prediction", F.lit(0.5))
    complete = df
    for name in FEATURES:
        complete = complete.withColumn(f"_has_{name}", F.col(name).isNotNull())
    filled = complete.fillna(0.0, subset=list(FEATURES))
    known = F.lit(True)
    for name in FEATURES:
        known = known & F.col(f"_has_{name}")
    out = model.transform(assemble(filled)).withColumn(
        "prediction", F.when(known, F.col("prediction")).otherwise(F.lit(0.5))
    )
    return out.select(*df.columns, "prediction")
