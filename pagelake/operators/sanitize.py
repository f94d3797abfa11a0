"""Removal of tracker and advert elements, and the protection snippet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import html as H
from pagelake.functions import let, urls

REMOVABLE = ("script", "iframe", "img", "link")


def _unwanted(e: Column, cfg: Settings) -> Column:
    source = F.coalesce(F.nullif(e["src"], F.lit("")), e["href"])
    tracker = F.coalesce(urls.is_tracker(urls.netloc(source), cfg), F.lit(False))
    return tracker | F.coalesce(urls.is_ad(e["class"], cfg), F.lit(False))


def remove_unwanted(html: Column, cfg: Settings = DEFAULT) -> Column:
    """The page without scripts, iframes, images and links that point at a tracker or
    carry an advert class. All other pieces of the page are kept as they are."""
    keep = lambda p: F.when(
        H.is_token(p) & H.tag_of(p).isin(*REMOVABLE), let(H.element(p, F.lit(0)), lambda e: ~_unwanted(e, cfg))
    ).otherwise(F.lit(True))
    return F.array_join(F.filter(H.pieces(html), keep), "")


def _head_tags(html: Column, wanted: Column) -> Column:
    """Characters before and through the first tag like ``wanted`` that is no part of a comment,
    script, style, frame or title; null if there is none."""

    def place(found: Column) -> Column:
        is_tag = lambda p: p.startswith("<") & F.startswith(F.lower(p), wanted) & p.rlike(rf"(?i)^(?:</head\s*>|<html\b{H.INSIDE}>)$")
        nth = F.array_position(F.transform(found, is_tag), F.lit(True)).cast("int")
        before = F.aggregate(F.slice(found, F.lit(1), F.greatest(nth - 1, F.lit(0))), F.lit(0), lambda n, t: n + F.length(t))
        return F.when(nth > 0, F.struct(before.alias("before"), (before + F.length(F.get(found, nth - 1))).alias("through")))

    return let(H.pieces(html, (*H.RAW, "title")), place)


def add_snippet(html: Column, snippet: Column) -> Column:
    """Snippet at the end of the head; a page without a head gets one after its html tag."""

    def cut(n: Column, *middle: Column) -> Column:
        return F.concat(F.substring(html, F.lit(1), n), *middle, F.substring(html, n + 1, F.length(html)))

    opened = F.coalesce(_head_tags(html, F.lit("<html"))["through"], F.lit(0))
    return F.coalesce(
        let(_head_tags(html, F.lit("</head"))["before"], lambda at: F.when(at.isNotNull(), cut(at, snippet))),
        let(opened, lambda at: cut(at, F.lit("<head>"), snippet, F.lit("</head>"))),
    )


def sanitize(analysed: DataFrame, cfg: Settings = DEFAULT, name: str = "clean_html") -> DataFrame:
    """Add the sanitised page to the result of the safety analysis."""
    clean = remove_unwanted(F.col("html"), cfg)
    staged = analysed.withColumn(name, clean)
    with_snippet = add_snippet(F.col(name), F.col("injection_script"))
    return staged.withColumn(
        name, F.when(F.col("sandbox_required"), with_snippet).otherwise(F.col(name))
    )
