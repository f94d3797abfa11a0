"""Store statistics, latencies and cache retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import keys, urls
from pagelake.operators.ranked import number_rows


def shard_stats(pages: DataFrame, links: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Pages, links and text size per shard; empty shards show zeros.

    ``pages``: (url, content); ``links``: (from_url, to_url). At most one row per
    shard leaves each task.
    """
    n = cfg.shard_count
    p = pages.groupBy(keys.shard_of_url(F.col("url"), n).cast("long").alias("shard")).agg(
        F.count("*").alias("pages"), F.sum(F.length("content")).alias("chars")
    )
    e = links.groupBy(keys.shard_of_url(F.col("from_url"), n).cast("long").alias("shard")).agg(
        F.count("*").alias("links")
    )
    every = pages.sparkSession.range(n).withColumnRenamed("id", "shard")
    zero = F.lit(0).cast("long")
    return (
        every.join(p, "shard", "left")
        .join(e, "shard", "left")
        .select(
            "shard",
            F.coalesce("pages", zero).alias("pages"),
            F.coalesce("links", zero).alias("links"),
            F.coalesce("chars", zero).alias("chars"),
            (F.coalesce("chars", zero) / F.lit(1048576.0)).alias("size_mb"),
        )
    )


def store_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.sum("pages").alias("total_pages"),
        F.sum("links").alias("total_links"),
        F.sum("size_mb").alias("total_size_mb"),
    )


def shard_report(stats: DataFrame) -> DataFrame:
    """Shard rows and the total row (shard null) in one pass."""
    return stats.rollup("shard").agg(
        F.sum("pages").alias("pages"), F.sum("links").alias("links"), F.sum("size_mb").alias("size_mb")
    )


def imbalance(stats: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Shards with more than 1.5 or less than 0.5 of the average page count."""
    # one row per shard, so a window over all of them is small
    avg = F.sum("pages").over(W.partitionBy(F.lit(1))) / F.lit(cfg.shard_count)
    with_avg = stats.withColumn("avg_pages", avg)
    odd = (F.col("pages") > F.col("avg_pages") * 1.5) | (F.col("pages") < F.col("avg_pages") * 0.5)
    return with_avg.select("shard", "pages", "avg_pages", odd.alias("unbalanced"))


def smoothed_latency(
    log: DataFrame, group: str, order: list[str], value: str, cfg: Settings = DEFAULT, chunk: int = 100_000
) -> DataFrame:
    """Running y = w * x + (1 - w) * y_before per group, starting from 0, for any weight in (0, 1].

    Rows are numbered across the cluster and cut into chunks, so a group that holds most
    of the log is smoothed by many tasks. In a chunk y is a running sum of values scaled by
    powers of 1 - w (a chunk ends before these leave the range of a double); what came
    before enters as one number per chunk, composed from the ends of the chunks before it
    as far back as a double can tell.
    """
    w = cfg.latency_weight
    decay = 1.0 - w
    if decay <= 0.0:
        return log.withColumn("smoothed", F.col(value).cast("double"))
    digits = -math.log10(decay)
    size = max(1, min(chunk, int(250 / digits)))
    reach = math.ceil(40 / (digits * size))
    numbered = number_rows(log, [group], order, "_rn")
    at = F.col("_rn") - 1
    placed = numbered.withColumn("_chunk", F.floor(at / size)).withColumn("_k", at % size + 1)
    sums = W.partitionBy(group, "_chunk").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    scaled = F.sum(F.col(value).cast("double") * w * F.pow(F.lit(decay), -F.col("_k"))).over(sums)
    own = placed.withColumn("_own", scaled * F.pow(F.lit(decay), "_k"))
    ends = own.groupBy(group, "_chunk").agg(F.max_by("_own", "_k").alias("_end"))
    before = W.partitionBy(group).orderBy("_chunk").rowsBetween(-reach, -1)
    carry = F.aggregate(F.collect_list("_end").over(before), F.lit(0.0), lambda acc, y: acc * decay**size + y)
    carried = ends.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), carry.alias("_carry"))
    joined = own.join(carried, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn("smoothed", F.col("_own") + F.col("_carry") * F.pow(F.lit(decay), "_k")).select(*log.columns, "smoothed")


def slow(smoothed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return smoothed.filter(F.col("smoothed") > cfg.slow_latency_s)


def crawl_summary(crawled: DataFrame, queued: DataFrame, time: str = "crawled_at") -> DataFrame:
    """Pages, distinct hosts, uptime in seconds and queue size, as one row."""
    queue = queued.agg(F.count("*").alias("q")).scalar()
    seconds = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / F.lit(1e6)
    return crawled.agg(
        F.count("*").alias("pages_crawled"),
        F.countDistinct(urls.netloc(F.col("url"))).alias("domains_count"),
        seconds.alias("uptime"),
    ).withColumn("queue_size", queue)


def keep_recent(cache: DataFrame, as_of: Column, cfg: Settings = DEFAULT, time: str = "cached_at") -> DataFrame:
    """Cached results of at most the retention time; exactly that age is kept."""
    return cache.filter(F.col(time) >= as_of - F.make_dt_interval(F.lit(cfg.search_cache_days)))


def operation_counts(log: DataFrame, op: str) -> DataFrame:
    return log.groupBy(op).agg(F.count("*").alias("n"))


def combined_report(totals: DataFrame, summary: DataFrame) -> DataFrame:
    """Store totals and crawl summary side by side; both inputs are single rows."""
    row = summary.select(F.struct("*").alias("r")).scalar()
    both = totals.withColumn("_s", row)
    return both.select(*totals.columns, *[F.col(f"_s.{c}").alias(c) for c in summary.columns])
