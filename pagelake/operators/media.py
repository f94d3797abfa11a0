"""Images and videos of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import inline_rows, literal_alternation, urls


def media(els: Column, url: Column, cfg: Settings = DEFAULT) -> Column:
    """struct<images, videos>; embedded players follow the video elements, unresolved."""
    null_text = F.lit(None).cast("string")
    images = F.transform(
        F.filter(els, lambda e: (e["tag"] == "img") & e["src"].isNotNull()),
        lambda e: F.struct(
            urls.resolve(url, e["src"]).alias("url"),
            F.coalesce(e["alt"], F.lit("")).alias("alt"),
            e["width"].alias("width"),
            e["height"].alias("height"),
            F.lit("image").alias("type"),
        ),
    )
    videos = F.transform(
        F.filter(els, lambda e: e["tag"].isin("video", "source") & (e["src"] != "")),
        lambda e: F.struct(
            urls.resolve(url, e["src"]).alias("url"),
            F.lit("video").alias("type"),
            F.when(e["tag"] == "video", e["poster"]).alias("poster"),
            F.lit(None).cast("boolean").alias("embed"),
        ),
    )
    embedded = F.transform(
        F.filter(els, lambda e: (e["tag"] == "iframe") & e["src"].rlike(literal_alternation(cfg.video_hosts))),
        lambda e: F.struct(
            e["src"].alias("url"), F.lit("video").alias("type"), null_text.alias("poster"), F.lit(True).alias("embed")
        ),
    )
    return F.struct(images.alias("images"), F.concat(videos, embedded).alias("videos"))


def media_rows(pages: DataFrame, key: str = "page_id", column: str = "media") -> DataFrame:
    """One row per media item, images first, with its position in its list."""
    null_text = F.lit(None).cast("string")
    images = F.transform(
        F.col(f"{column}.images"),
        lambda m, i: F.struct(
            (i + 1).cast("long").alias("position"), m["type"].alias("type"), m["url"].alias("media_url"),
            m["alt"].alias("alt"), m["width"].alias("width"), m["height"].alias("height"),
            null_text.alias("poster"), F.lit(False).alias("embed"),
        ),
    )
    videos = F.transform(
        F.col(f"{column}.videos"),
        lambda m, i: F.struct(
            (i + 1).cast("long").alias("position"), m["type"].alias("type"), m["url"].alias("media_url"),
            null_text.alias("alt"), null_text.alias("width"), null_text.alias("height"),
            m["poster"].alias("poster"), F.coalesce(m["embed"], F.lit(False)).alias("embed"),
        ),
    )
    return inline_rows(pages, [key], F.concat(images, videos), "position")


def media_json(column: Column) -> Column:
    """Text form of the media struct, absent values written as null."""
    return F.to_json(column, {"ignoreNullFields": "false"})
