"""The crawl as a stream: pages arrive in a folder and end up in the store.

The store is append-only: each micro-batch writes its own folder and overwrites it when
the batch is replayed, so a restart neither loses nor doubles rows. Readers resolve
versions by key; ``compact`` folds them into a new snapshot. No batch rewrites old data.
``ingest_merged`` keeps one snapshot per shard instead, for stores that are read more often than written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.config import DEFAULT, Settings
from pagelake.functions import keys, urls
from pagelake.operators import links as L
from pagelake.operators.upsert import replace_upsert
from pagelake.plans.crawl import analysed_pages, stored_pages
from pagelake.sources import snapshots
from pagelake.sources.pages import spread
from pagelake.sources.store import write_pages


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None, mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def ingest(
    pages: DataFrame, store: str, checkpoint: str, cfg: Settings = DEFAULT, interval: str | None = None
) -> StreamingQuery:
    """Analyse, sanitise and store pages as they arrive."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = stored_pages(analysed_pages(spread(batch, "url"), cfg), cfg)
        write_pages(rows.drop("out_links"), f"{store}/epoch={epoch}", cfg, mode="overwrite")

    return _start(pages, write, checkpoint, interval)


def ingest_merged(
    pages: DataFrame, store: str, checkpoint: str, order: list[str], cfg: Settings = DEFAULT, interval: str | None = None
) -> StreamingQuery:
    """Analyse and sanitise pages as they arrive and merge them into the snapshots of their shards."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = stored_pages(analysed_pages(spread(batch, "url"), cfg), cfg)
        snapshots.merge_batch(rows.drop("out_links"), store, epoch, order, cfg)

    return _start(pages, write, checkpoint, interval)


def current_pages(spark: SparkSession, store: str, order: list[str], shard: int | None = None) -> DataFrame:
    """Newest version of each stored page; later batches win ties.

    With a shard number only that shard's folders are read.
    """
    rows = spark.read.parquet(store)
    if shard is not None:
        rows = rows.filter(F.col("shard") == shard)
    return replace_upsert(rows, "url", [*order, "epoch"]).drop("epoch")


def compact(spark: SparkSession, store: str, target: str, order: list[str], cfg: Settings = DEFAULT) -> None:
    """Write the resolved pages to a new folder that readers can switch to."""
    current = current_pages(spark, store, order).drop("url_hash", "shard")
    write_pages(current, f"{target}/epoch=-1", cfg)


#: Registers of the sketch of hosts: 2 ** 14, a standard error below one per cent.
SKETCH_BITS = 14


def _epochs(spark: SparkSession, target: str) -> list[int]:
    """Batches that have written their folder, by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def host_counts(pages: DataFrame) -> DataFrame:
    """Pages per host, exact: one row per host."""
    return pages.groupBy(urls.netloc(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def summary_row(pages: DataFrame) -> DataFrame:
    """Pages and a sketch of their hosts, in one row; each task sends one sketch, however many hosts it meets."""
    # the sketch leaves out empty strings, so the host gets slashes before it
    host = F.concat(F.lit("//"), urls.netloc(F.col("url")))
    return pages.agg(F.count("*").alias("pages_crawled"), F.hll_sketch_agg(host, SKETCH_BITS).alias("hosts"))


def running_summary(pages: DataFrame, target: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep pages and distinct hosts up to date, one result row per batch.

    A batch adds its own row to that of the batch before it, so neither state nor output grows with the
    hosts. A repeated batch starts from the same row again and overwrites its own.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, rows = batch.sparkSession, summary_row(batch)
        before = [e for e in _epochs(spark, target) if e < epoch]
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{target}/epoch={before[-1]}"))
        total = rows.agg(F.sum("pages_crawled").alias("pages_crawled"), F.hll_union_agg("hosts").alias("hosts"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return _start(pages, write, checkpoint, interval)


def newest_summary(spark: SparkSession, target: str) -> DataFrame:
    """pages_crawled and domains_count (estimated; exact for some hundred hosts) after the last batch."""
    last = spark.read.parquet(f"{target}/epoch={_epochs(spark, target)[-1]}")
    return last.select("pages_crawled", F.hll_sketch_estimate("hosts").alias("domains_count"))


def once_per_hour(pages: DataFrame, time: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Drop a page already seen within the cache time, by analysis key."""
    keyed = pages.withColumn("analysis_key", keys.analysis_key(F.col("url"), F.col("html")))
    delay = f"{cfg.analysis_ttl_s} seconds"
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["analysis_key"])


def store_stream(stream: DataFrame, target: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return _start(stream, write, checkpoint, interval)


def grow_frontier(
    pages: DataFrame, target: str, checkpoint: str, cfg: Settings = DEFAULT, interval: str | None = None
) -> StreamingQuery:
    """Queue the links of arriving pages, once per address over all batches.

    Which addresses were seen is keyed state of the stream, spread over the cluster, so a
    batch costs as much as its own pages however long the stream has run. For many
    addresses set the RocksDB state store.
    """
    done = analysed_pages(pages, cfg)
    own = F.struct("url", F.lit(L.PRIORITY_DEFAULT).alias("priority"), F.lit(True).alias("crawled"))
    found = F.transform(
        F.coalesce(L.targets(done, "clean_html"), F.array().cast("array<string>")),
        lambda u: F.struct(u.alias("url"), F.lit(L.PRIORITY_LINK).alias("priority"), F.lit(False).alias("crawled")),
    )
    rows = done.select(F.inline(F.concat(F.array(own), found)))
    return store_stream(rows.dropDuplicates(["url", "crawled"]), target, checkpoint, interval)


def waiting_urls(spark: SparkSession, target: str) -> DataFrame:
    """Queued addresses no batch has fetched yet."""
    rows = spark.read.parquet(target)
    crawled = rows.filter("crawled").select("url")
    return L.frontier(rows.filter("not crawled").select("url", "priority"), crawled)


