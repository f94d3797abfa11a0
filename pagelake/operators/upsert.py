"""Upserts as aggregations: partial results are formed before the shuffle, so a key
that holds a third of all rows leaves each task as one row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a stored page that fall back to a default.
DEFAULTS = {"popularity": 0}


def _latest(columns: list[str], order: list[str], newest: bool = True):
    pick = F.max_by if newest else F.min_by
    return pick(F.struct(*columns), F.struct(*order))


def replace_upsert(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whole-row replace: the newest row of each key wins. ``order`` must be unique per key."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(_latest(rest, order).alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in df.columns])
    )


def replace_into(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replace stored rows by incoming ones; columns an incoming row lacks are reset."""
    for name, value in DEFAULTS.items():
        if name in stored.columns and name not in incoming.columns:
            incoming = incoming.withColumn(name, F.lit(value).cast(stored.schema[name].dataType))
    both = stored.unionByName(incoming, allowMissingColumns=True)
    return replace_upsert(both, key, order)


def merge_upsert(
    df: DataFrame, key: str, order: list[str], newest: list[str], first: list[str], latest_time: str
) -> DataFrame:
    """Partial merge: some columns follow the newest row, some keep the first stored value."""
    merged = df.groupBy(key).agg(
        _latest(newest, order).alias("_new"),
        _latest(first, order, newest=False).alias("_old"),
        F.max(latest_time).alias(latest_time),
    )
    return merged.select(
        key,
        *[F.col(f"_new.{c}").alias(c) for c in newest],
        *[F.col(f"_old.{c}").alias(c) for c in first],
        latest_time,
    )


def insert_or_ignore(incoming: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """New distinct keys only; ``stored`` keys win over incoming ones."""
    fresh = incoming.dropDuplicates(keys)
    return fresh if stored is None else fresh.join(stored.select(*keys), keys, "left_anti")


def once_per_key(df: DataFrame, key: str, time: str, ttl_s: int) -> DataFrame:
    """Analyses that are made: a row is left out if its key was analysed at most ``ttl_s`` seconds before.

    Only rows that are made count as analysed, so a chain of close rows is cut at the limit. Distinct
    times meet first (partial step). Each key's times are then sorted, which spills to disk, and read in
    order with the last analysis as the only state. A key lies in one task, but never in one row.
    """
    micros, limit = F.unix_micros(time), ttl_s * 1_000_000
    kind = df.schema[key].dataType.simpleString()
    ordered = df.select(F.col(key).alias("_key"), micros.alias("_at")).filter("_key IS NOT NULL AND _at IS NOT NULL").distinct().repartition("_key").sortWithinPartitions("_key", "_at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for batch in batches:
            made = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != last_key or t - last > limit:
                    last_key, last = k, t
                    made.append(i)
            yield batch.take(pa.array(made, pa.int64()))

    times = ordered.mapInArrow(run, f"_key {kind}, _at long").withColumnRenamed("_key", key)
    first = df.withColumn("_at", micros).dropDuplicates([key, "_at"])
    return first.join(times, [key, "_at"]).drop("_at")
