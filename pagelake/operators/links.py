"""Link graph and crawl planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import html as H
from pagelake.functions import explode_rows, urls
from pagelake.operators.ranked import number_rows
from pagelake.operators.upsert import insert_or_ignore

# Queue priorities, smallest first.
PRIORITY_LINK, PRIORITY_DEFAULT, PRIORITY_INDEXED = 0, 1, 5


def hrefs(html: Column, include_boilerplate: bool = False) -> Column:
    """Link targets as written. Those inside nav and footer are unseen by default."""
    found = H.tokens(html) if include_boilerplate else H.tokens_outside(html)
    anchors = F.filter(H.elements_of(found), lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    return F.transform(anchors, lambda e: e["href"])


def outgoing(url: Column, html: Column, include_boilerplate: bool = False) -> Column:
    """Distinct absolute http(s) targets of one page, first appearance first."""
    absolute = urls.resolve_all(url, F.array_distinct(hrefs(html, include_boilerplate)))
    return F.array_distinct(F.filter(absolute, urls.is_web))


def targets(pages: DataFrame, html: str = "html", include_boilerplate: bool = False) -> Column:
    """Link targets of a page; null if the page is sandboxed."""
    found = outgoing(F.col("url"), F.col(html), include_boilerplate)
    return F.when(~F.col("sandbox_required"), found) if "sandbox_required" in pages.columns else found


def edges(pages: DataFrame, html: str = "html", include_boilerplate: bool = False) -> DataFrame:
    """Edges (from_url, to_url) of pages that are not sandboxed; distinct within a page."""
    return explode_rows(pages, [F.col("url").alias("from_url")], targets(pages, html, include_boilerplate), "to_url")


def stored_edges(rows: DataFrame) -> DataFrame:
    """Edges from the link column of stored pages."""
    return explode_rows(rows, [F.col("url").alias("from_url")], F.col("out_links"), "to_url")


def distinct_edges(links: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    return insert_or_ignore(links, ["from_url", "to_url"], stored)


def link_share(links: DataFrame) -> DataFrame:
    """Share of all edges that point at each address."""
    counts = links.groupBy("to_url").agg(F.count("*").alias("n_in"))
    # the subquery reuses the exchange of the counts
    total = counts.agg(F.sum("n_in").alias("t")).scalar()
    return counts.select("to_url", "n_in", (F.col("n_in") / total).alias("share"))


def frontier(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses still to fetch: best priority of each, already seen ones left out.

    ``candidates`` has (url, priority), ``seen`` has (url). Both sides are reduced to
    distinct addresses before the anti join, so a hub address is one row.
    """
    best = candidates.groupBy("url").agg(F.min("priority").alias("priority"))
    return best.join(seen.select("url").distinct(), "url", "left_anti")


def next_urls(waiting: DataFrame, k: int) -> DataFrame:
    """The first k addresses in queue order."""
    return waiting.orderBy("priority", "url").limit(k)


def fetch_timetable(waiting: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Earliest start of each fetch in seconds, so that one host is asked at most every
    ``crawl_delay_s``. A host with most of the queue is numbered across many tasks."""
    hosted = waiting.withColumn("host", urls.netloc(F.col("url")))
    numbered = number_rows(hosted, ["host"], ["priority", "url"], "turn")
    return numbered.withColumn("start_s", (F.col("turn") - 1) * F.lit(cfg.crawl_delay_s))


def sites_to_discover(pages: DataFrame) -> DataFrame:
    """http:// + host for each distinct crawled host."""
    return (
        pages.select(urls.netloc(F.col("url")).alias("host"))
        .distinct()
        .select("host", F.concat(F.lit("http://"), F.col("host")).alias("site_url"))
    )
