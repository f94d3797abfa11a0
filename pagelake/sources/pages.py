"""Reading fetched pages and sitemaps, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import explode_rows, urls
from pagelake.functions.html import decode_entities

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

LOC = r"(?is)<loc\b[^>]*>(.*?)</loc\s*>"


def fetched(df: DataFrame) -> DataFrame:
    """Keep successful fetches; a table without a status column is all success."""
    return df.filter(F.col("status") == 200) if "status" in df.columns else df


def spread(df: DataFrame, key: str, parts: int = 0) -> DataFrame:
    """Give a small input enough partitions for all cores, and any input at least ``parts``.

    One row group is one task, so a table of one small file would run on one core. A
    table with at least as many splits as cores (and ``parts``) is left alone: nothing is shuffled.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, parts)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def read_table(spark: SparkSession, path: str, key: str, task_bytes: int = 0) -> DataFrame:
    """A stored table; with ``task_bytes`` in tasks of about as many stored bytes, however large its row groups."""
    df = spark.read.parquet(path)
    return spread(df, key, -(-_stored_bytes(spark, path) // task_bytes) if task_bytes else 0)


def _stored_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


#: Stored bytes of pages in a task: a page takes milliseconds, its bytes are few, so a shuffle pays.
PAGE_TASK = 4 << 20


def read_pages(spark: SparkSession, path: str, key: str = "url") -> DataFrame:
    return fetched(read_table(spark, path, key, PAGE_TASK))


def stream_pages(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.parquet",
    schema: T.StructType = PAGE_SCHEMA,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Pages as they arrive in a folder."""
    return fetched(
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def sitemap_locations(xml: Column) -> Column:
    """Every trimmed <loc> text that starts with "http"."""
    found = F.transform(
        F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)),
        lambda u: decode_entities(F.regexp_replace(u, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")),
    )
    return F.filter(found, urls.starts_with_http)


def sitemap_urls(sitemaps: DataFrame, text: str = "xml") -> DataFrame:
    keep = [c for c in sitemaps.columns if c != text]
    return explode_rows(sitemaps, keep, sitemap_locations(F.col(text)), "loc")


def read_sitemap_xml(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of well-formed sitemap files, one entry per row; big files are split."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .schema("loc string")
        .load(path)
    )
    trimmed = rows.select(F.trim("loc").alias("loc"))
    return trimmed.filter(urls.starts_with_http(F.col("loc")))


def sitemap_candidates(sites: DataFrame, url: str = "url") -> DataFrame:
    """The two sitemap addresses of each site, once per site."""
    root = F.concat(urls.scheme(F.col(url)), F.lit("://"), urls.netloc(F.col(url)))
    return (
        sites.select(root.alias("site"))
        .distinct()
        .select(
            "site",
            F.concat("site", F.lit("/sitemap.xml")).alias("first_url"),
            F.concat("site", F.lit("/sitemap_index.xml")).alias("fallback_url"),
        )
    )


def choose_sitemaps(candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """Pick per site the first candidate fetched with status 200.

    ``fetches`` holds (url, status, xml). A site with neither file drops out.
    """
    good = fetches.filter(F.col("status") == 200).select("url", "xml")
    first = good.select(F.col("url").alias("first_url"), F.col("xml").alias("first_xml"))
    second = good.select(F.col("url").alias("fallback_url"), F.col("xml").alias("second_xml"))
    return (
        candidates.join(first, "first_url", "left")
        .join(second, "fallback_url", "left")
        .select(
            "site",
            F.when(F.col("first_xml").isNotNull(), F.col("first_url"))
            .otherwise(F.col("fallback_url"))
            .alias("sitemap_url"),
            F.coalesce("first_xml", "second_xml").alias("xml"),
        )
        .filter(F.col("xml").isNotNull())
    )
