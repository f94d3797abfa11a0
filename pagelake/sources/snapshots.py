"""A page store kept as one snapshot per shard: a batch rewrites the shards it touches and no other.

Each batch writes the new snapshots of its shards into a folder of its own and then names them in the state
of the table (see ``commits``), so readers see it whole or not at all. They read one folder per shard and
need not resolve versions. A batch that is repeated is skipped; one that died is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.operators.upsert import replace_upsert
from pagelake.sources.commits import commit, drop_folders, read_state
from pagelake.sources.store import broadcast_if_small, materialise, with_keys


def _folder(path: str, version: int) -> str:
    return f"{path}/data/v={version}"


def merge_batch(batch: DataFrame, path: str, epoch: int, order: list[str], cfg: Settings = DEFAULT) -> list[int]:
    """Merge rows into the store; the shards rewritten. Of versions of a page the one highest in ``order`` stays,
    of equal ones that of the later batch.

    Stored pages that the batch does not name are copied without a shuffle by address.
    """
    spark = batch.sparkSession
    number, state = read_state(spark, path)
    if epoch <= state.get("epoch", -1):
        return []
    keyed = with_keys(batch, cfg).withColumn("epoch", F.lit(epoch).cast("long"))
    incoming = materialise(replace_upsert(keyed, "url", [*order, "epoch"]), "incoming")
    touched = sorted(r["shard"] for r in incoming.select("shard").distinct().collect())  # at most the number of shards
    snapshots = dict(state.get("shards", {}))
    old = [f"{_folder(path, snapshots[str(s)])}/shard={s}" for s in touched if str(s) in snapshots]
    rows = incoming
    if old:
        stored = _read(spark, path, old).select(*incoming.columns)
        named = broadcast_if_small(incoming.select("url"))
        clash = stored.join(named, "url", "left_semi").unionByName(incoming)
        rows = stored.join(named, "url", "left_anti").unionByName(replace_upsert(clash, "url", [*order, "epoch"]))
    clustered = [c for c in ("domain", "crawled_at", "url") if c in rows.columns]
    (
        rows.hint("rebalance", F.col("shard"))
        .sortWithinPartitions("shard", *clustered)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("shard")
        .parquet(_folder(path, number + 1))
    )
    snapshots |= {str(s): number + 1 for s in touched}
    commit(spark, path, number, {"epoch": epoch, "shards": snapshots})
    return touched


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("v")


def read_snapshot(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """The pages of the store, or of one shard; only its folder is listed and read then."""
    _, state = read_state(spark, path)
    wanted = {s: v for s, v in state.get("shards", {}).items() if shard is None or int(s) == shard}
    if not wanted:
        raise ValueError(f"no pages at {path}" + ("" if shard is None else f" in shard {shard}"))
    return _read(spark, path, [f"{_folder(path, v)}/shard={s}" for s, v in wanted.items()]).drop("epoch")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete snapshots that the last state does not name; call when no reader is left."""
    _, state = read_state(spark, path)
    live = {f"v={v}/shard={s}" for s, v in state.get("shards", {}).items()}
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/v=*/shard=*")
    statuses = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or ()
    gone = [s.getPath() for s in statuses if f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" not in live]
    drop_folders(spark, [str(p.toString()) for p in gone])
    return len(gone)
