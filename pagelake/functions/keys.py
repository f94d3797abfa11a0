"""Page keys and shard numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def html_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def analysis_key(url: Column, html: Column) -> Column:
    """md5 of url, underscore and the number of characters of the page."""
    return F.md5(F.concat_ws("_", url, F.length(html).cast("string")))


def shard_of_hash(digest: Column, shards: int) -> Column:
    """The whole digest, read as one hexadecimal number, modulo ``shards``.

    A power of 16 only needs the trailing digits. Other counts fold 7 digits at
    a time, so every intermediate value stays far below 2**63.
    """
    power, digits = 1, 0
    while power < shards:
        power, digits = power * 16, digits + 1
    if power == shards:
        tail = F.conv(F.right(digest, F.lit(max(digits, 1))), 16, 10).cast("int")
        return tail if digits else tail * 0
    chunks = F.regexp_extract_all(digest, F.lit("[0-9a-f]{1,7}"), F.lit(0))
    return F.aggregate(
        chunks,
        F.lit(0).cast("long"),
        lambda acc, c: (
            acc * F.pow(F.lit(16.0), F.length(c)).cast("long")
            + F.conv(c, 16, 10).cast("long")
        )
        % F.lit(shards),
    ).cast("int")


def shard_of_url(url: Column, shards: int = 16) -> Column:
    """Placement rule of the page store."""
    return shard_of_hash(url_hash(url), shards)


def shard_of_hash_head(digest: Column, shards: int = 16) -> Column:
    """Other shard number, from the first eight digits only."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(shards)).cast("int")
