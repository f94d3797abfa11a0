"""Page store on Parquet, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import keys

_DIR_KEY = "spark.checkpoint.dir"
_local_folder: str | None = None
_intermediate: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    global _local_folder
    configured = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_DIR_KEY} to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="pagelake-")
    return _local_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage on reliable storage, so a lost executor costs a re-read and
    not a re-computation. Unlike an RDD checkpoint the copy is columnar, so later
    readers load only the columns they use.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _intermediate.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables ``materialise`` wrote in this process, once their results are used."""
    conf = spark._jsc.hadoopConfiguration()
    dropped = 0
    while _intermediate:
        path = spark._jvm.org.apache.hadoop.fs.Path(_intermediate.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def is_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> bool:
    """Whether a table is provably small enough for one executor's memory.

    Each task sends one row of partial sums, whatever it holds. Give a stored table, or one
    that is cheap to compute twice.
    """
    row = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast after a size check; else leave the join to shuffle and AQE."""
    return F.broadcast(df) if is_small(df) else df


def with_keys(pages: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Drop rows without an address and add url_hash and shard."""
    return (
        pages.filter(F.col("url").isNotNull() & (F.col("url") != ""))
        .withColumn("url_hash", keys.url_hash(F.col("url")))
        .withColumn("shard", keys.shard_of_hash(F.col("url_hash"), cfg.shard_count))
    )


def write_pages(pages: DataFrame, path: str, cfg: Settings = DEFAULT, mode: str = "error") -> None:
    """Write pages as one folder per shard, column chunks compressed with zstd.

    The rebalance hint lets the adaptive planner cut a large shard into many
    tasks and pack small ones, so files have an even size whatever the skew. Rows lie by
    host and time (where there are such columns), so a search for one host, or for its
    newest pages, skips the other row groups.
    """
    keyed = with_keys(pages, cfg)
    clustered = [c for c in ("domain", "crawled_at", "url") if c in keyed.columns]
    (
        keyed.hint("rebalance", F.col("shard"))
        .sortWithinPartitions("shard", *clustered)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )


def read_pages(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """Stored pages; with a shard number only that folder is listed and read."""
    pages = spark.read.parquet(path)
    return pages if shard is None else pages.filter(F.col("shard") == shard)


def read_query(
    spark: SparkSession, path: str, sql: str, args: dict | None = None, shard: int | None = None
) -> DataFrame:
    """Run a parametrised query over the stored pages, named ``{pages}`` in the text."""
    return spark.sql(sql, args=args or {}, pages=read_pages(spark, path, shard))
