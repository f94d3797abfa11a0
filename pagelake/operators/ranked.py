"""Numbering and top-k that stay distributed when one group holds most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.sources.store import broadcast_if_small, materialise

# Spark prunes "row_number <= k" before the shuffle up to this k.
_PRUNED_K = 1000


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, salt: str, rank: str = "rank", salts: int = 64
) -> DataFrame:
    """Exact first ``k`` rows per group.

    Small k: the engine's own group limit keeps k rows per task before the
    shuffle. Large k: a first round per (group, hash of ``salt``) does the same, so
    the last round sees at most ``salts * k`` rows of a group.
    """
    if k > _PRUNED_K:
        part = F.pmod(F.xxhash64(salt), F.lit(salts))
        first = W.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", part)
            .withColumn("_rn", F.row_number().over(first))
            .filter(F.col("_rn") <= k)
            .drop("_rn", "_salt")
        )
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    # cast after the filter: the group limit only recognises the bare row number
    return numbered.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based position of each row in its group, in ascending ``order``.

    A window would sort a whole group in one task. Here the rows are sorted across
    the cluster by (group, order): a large group spans many partitions, each row
    gets its position inside its partition, and a small table of row counts per
    (partition, group) supplies the offsets. ``order`` must be unique in a group.
    """
    keys = [*group, *order]
    sorted_rows = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # written once: partition numbers must not change between the two readers
    rows = materialise(sorted_rows, "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row per partition that holds part of the group, never one per input row
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = broadcast_if_small(offsets.select(*[F.col(c).alias(f"_g_{c}") for c in ["_part", *group]], "_first", "_offset"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in ["_part", *group]]
    return (
        rows.join(offsets, reduce(lambda a, b: a & b, same), "left")
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_offset") + 1)
        .select(*df.columns, name)
    )
