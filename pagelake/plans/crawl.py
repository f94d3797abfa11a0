"""From fetched pages to stored pages, keywords and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import html as H
from pagelake.functions import keys
from pagelake.functions import text as T
from pagelake.operators import links as L
from pagelake.operators.media import media
from pagelake.operators.safety import analyze
from pagelake.operators.sanitize import sanitize
from pagelake.sources.store import materialise


def analysed_pages(pages: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Safety columns from the original page and the sanitised page next to it."""
    return sanitize(analyze(pages, cfg), cfg)


def stored_pages(analysed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One store row per page. Title, text and media come from the sanitised page, the
    content hash from the original. A single narrow stage: nothing is shuffled."""
    url, clean = F.col("url"), F.col("clean_html")
    staged = analysed.withColumn("content", H.page_text(clean, H.CRAWL_DROP)).withColumn("_els", H.elements(clean))
    optional = {
        "http_status": F.col("status").cast("int") if "status" in analysed.columns else F.lit(200),
        "content_type": F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit(""))
        if "headers" in analysed.columns
        else F.lit(""),
    }
    return staged.select(
        keys.url_hash(url).alias("url_hash"),
        "url",
        H.title(clean, url).alias("title"),
        "content",
        keys.html_hash(F.col("html")).alias("html_hash"),
        *[c for c in ("crawled_at", "seq") if c in analysed.columns],
        optional["http_status"].alias("http_status"),
        optional["content_type"].alias("content_type"),
        T.word_count(F.col("content")).alias("word_count"),
        F.col("score").alias("security_score"),
        F.col("sandbox_required").alias("is_dangerous"),
        media(F.col("_els"), url, cfg).alias("media"),
        "domain",
        F.lit(0).alias("popularity"),
        T.keyword_text(F.col("content"), cfg).alias("keywords"),
        F.when(~F.col("sandbox_required"), L.outgoing(url, clean)).alias("out_links"),
    )


@dataclass(frozen=True)
class Crawl:
    pages: DataFrame
    links: DataFrame
    waiting: DataFrame


def crawl(pages: DataFrame, cfg: Settings = DEFAULT) -> Crawl:
    """All tables of one batch of fetched pages.

    The page text is read once: links and frontier come from the link column of the
    written store rows.
    """
    rows = materialise(stored_pages(analysed_pages(pages, cfg), cfg), "stored")
    links = L.distinct_edges(L.stored_edges(rows))
    candidates = links.select(F.col("to_url").alias("url"), F.lit(L.PRIORITY_LINK).alias("priority"))
    return Crawl(rows.drop("out_links"), links, L.frontier(candidates, rows))


def index_directly(pages: DataFrame, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Pages handed in with their title: store rows, and the addresses to queue."""
    analysed = analyze(pages, cfg)
    title = F.col("title") if "title" in pages.columns else H.title(F.col("html"), F.col("url"))
    rows = analysed.select(
        keys.url_hash(F.col("url")).alias("url_hash"),
        "url",
        title.alias("title"),
        "html",
        F.col("score").alias("security_score"),
        F.col("sandbox_required").alias("is_dangerous"),
        "domain",
        H.page_text(F.col("html"), H.INDEX_DROP).alias("text"),
    )
    queued = pages.select("url", F.lit(L.PRIORITY_INDEXED).alias("priority"))
    return rows, queued
