"""A search from query text to ranked result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.operators import index as I
from pagelake.operators import rank as R
from pagelake.operators import search as S
from pagelake.sources.store import broadcast_if_small, materialise


def search(
    queries: DataFrame,
    docs: DataFrame,
    doc: str,
    fields: list[str],
    cfg: Settings = DEFAULT,
    match: str = "all",
    fold_accents: bool = False,
) -> DataFrame:
    """(query_id, doc_id, score) of every matching document. ``match`` is all or any."""
    if match not in ("all", "any"):
        raise ValueError("match is all or any")
    parsed = S.parse(queries)
    hits = I.scan_hits(docs, doc, I.tokens_of(fields, fold_accents), S.terms_of(parsed))
    return S.match_all(parsed, hits, cfg) if match == "all" else S.match_any(parsed, hits, cfg)


def search_top(
    queries: DataFrame, docs: DataFrame, doc: str, fields: list[str], k: int, cfg: Settings = DEFAULT, match: str = "all"
) -> DataFrame:
    """(query_id, doc_id, score, rank): the first k documents of each query."""
    if match == "all":
        return S.top(search(queries, docs, doc, fields, cfg), k)
    parsed = S.parse(queries)
    hits = I.scan_hits(docs, doc, I.tokens_of(fields), S.terms_of(parsed))
    return S.top_any(parsed, hits, k, cfg).drop("n_matched")


def results(tops: DataFrame, queries: DataFrame, pages: DataFrame, doc: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Titles, addresses and excerpts of result lists. ``pages``: (doc, url, title)."""
    parsed = S.parse(queries).select("query_id", "terms")
    listed = tops.join(broadcast_if_small(parsed), "query_id")
    texts = pages.select(F.col(doc).alias("doc_id"), "url", "title")
    return listed.join(texts, "doc_id").select(
        "query_id", "doc_id", "rank", "url", "title", S.excerpt(F.col("title"), F.col("terms"), cfg.excerpt_words).alias("excerpt")
    )


def ranked_search(
    queries: DataFrame,
    pages: DataFrame,
    doc: str,
    shares: DataFrame,
    as_of: Column,
    cfg: Settings = DEFAULT,
    match: str = "all",
    k: int | None = None,
) -> DataFrame:
    """Full search: BM25 candidates, then the composite ranking over them.

    ``pages``: (doc, url, title, content, crawled_at, security_score).
    """
    k = k or cfg.per_page
    tops = materialise(search_top(queries, pages, doc, ["title", "content"], k, cfg, match), "tops")
    joined = broadcast_if_small(tops).join(pages.withColumnRenamed(doc, "doc_id"), "doc_id")
    similarity = R.tfidf_cosine(joined.select("query_id", "doc_id", "title", "content"), queries, cfg)
    hits = joined.join(similarity, ["query_id", "doc_id"]).select(
        "query_id", "doc_id", "url", "title", "similarity", "crawled_at",
        F.col("security_score").alias("safety"), F.col("rank").alias("input_rank"),
    )
    return R.top_hits(R.score_hits(hits, shares, as_of, cfg), k)


def suggest(queries: DataFrame, docs: DataFrame, doc: str, title: str = "title", cfg: Settings = DEFAULT) -> DataFrame:
    """Best titles for queries still being typed: the last word is a beginning."""
    parsed = S.parse_prefix(queries)
    tokens = I.tokens_of([title])
    hits = I.scan_hits(docs, doc, tokens, S.terms_of(parsed), extra_terms=S.prefix_terms(F.col("_tokens")))
    return S.top(S.match_all(parsed, hits, cfg), cfg.suggest_limit)
