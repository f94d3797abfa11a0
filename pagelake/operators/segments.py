"""A stored index that takes replacements: posting segments, tombstones, tiered merges, block-max top-k.

Each batch of documents becomes a segment of its own, and nothing written before is touched: the documents it
replaces (or deletes) are listed as tombstones of the older segments that hold them, with the terms they take
out of the term counts. A merge unites segments of one size class once there are ``fanout`` of them, so a
posting is rewritten once per size class and segments of other classes stay as they are. A batch or merge
counts from the rename of its state file on, and a batch that is repeated is skipped.

A segment deals its documents by hash to slots of about ``slot_docs``. The postings of a term in a slot are one
row, a block: a hot term is many blocks, none larger than a slot. Files lie in folders by term bucket, sorted by
(term, slot). Each block carries the largest BM25 weight in it, for the segment's own average length; a
search with another average stretches it so that it stays a bound.

``top_stored`` finds the first k documents of each query exactly. Adding up the blocks' bounds per slot bounds
every document of the slot; the postings themselves are read for the best slots only, whose k-th score then tells
which other slots can still hold a better document.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from pagelake.config import DEFAULT, Settings
from pagelake.functions import text as T
from pagelake.functions.runs import runs, text_slices
from pagelake.operators import search as S
from pagelake.operators.index import PUSHED_TERMS, Hits, _document_frequency, bucket_of, spaced_text
from pagelake.operators.ranked import top_per_group
from pagelake.sources.commits import commit, drop_folders, read_state
from pagelake.sources.store import broadcast_if_small, materialise


@dataclass(frozen=True)
class Layout:
    """Documents of a slot, segments of a size class that are merged, ranges of slots pushed to a scan."""

    slot_docs: int = 128
    fanout: int = 4
    ranges: int = 64


def _slot(doc: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(slots))


#: Tokens of a task that writes blocks, and those below which no more tasks are used; texts (bytes) turned at once.
_PART_TOKENS, _LEAST_TOKENS, _TURNED = 8 << 20, 1 << 19, 8 << 20


def _blocks(texts: DataFrame, average: float, cfg: Settings) -> DataFrame:
    """(term, slot, n, most, entries) of texts that lie by slot and document, a slot in one partition."""
    doc = texts.schema["doc_id"].dataType
    entries = ArrayType(StructType([StructField("doc_id", doc), *StructType.fromDDL("dl long, tf long, positions array<int>")]))
    schema = StructType([*StructType.fromDDL("term string, slot long, n int, most double"), StructField("entries", entries)])

    def turned(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        texts, slots = table["_text"].combine_chunks(), table["slot"].to_numpy()
        found = runs(texts)
        coded = found.term.dictionary_encode()
        codes, slot = np.asarray(coded.indices, np.int64), slots[found.row]
        by = np.lexsort((found.row, codes, slot))  # rows lie by document
        codes, slot, row = codes[by], slot[by], found.row[by]
        start = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (slot[1:] != slot[:-1]))) if len(by) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(by)))
        tf, dl = found.tf[by], found.dl[row]
        weight = S.term_weight(1.0, tf, dl, average, cfg)
        most = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
        entry = pa.StructArray.from_arrays(
            [table["doc_id"].combine_chunks().take(pa.array(row)), pa.array(dl), pa.array(tf), found.positions().take(pa.array(by))], ["doc_id", "dl", "tf", "positions"]
        )
        ends = pa.array(np.append(start, len(by)).astype(np.int32))
        made = [coded.dictionary.take(pa.array(codes[start])), pa.array(slot[start]), pa.array(n.astype(np.int32)), pa.array(most), pa.ListArray.from_arrays(ends, entry)]
        return pa.RecordBatch.from_arrays(made, ["term", "slot", "n", "most", "entries"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in text_slices(batches, "_text"):
            # whole slots are turned; the last one may go on
            last = batch.column("slot").to_numpy()
            cut = int(np.searchsorted(last, last[-1]))
            if sum(b.nbytes for b in held) > _TURNED and (cut or held[-1].column("slot")[-1].as_py() != last[0]):
                yield turned(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield turned(pa.Table.from_batches(held))

    return texts.select("doc_id", F.col("text").alias("_text"), "slot").mapInArrow(run, schema)


def _write_segment(spark: SparkSession, path: str, name: str, layout: Layout, cfg: Settings) -> dict:
    """Postings of the texts already stored in the segment; what the state has to know of it."""
    texts = spark.read.parquet(f"{path}/segments/{name}/texts")
    totals = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    n, total = totals["n"], totals["dl"]
    slots, average = max(1, -(-n // layout.slot_docs)), (total / n if n and total else 1.0)
    # the only exchange: texts meet by slot, so the blocks of a slot are made where its texts are
    parts = max(min(slots, spark.sparkContext.defaultParallelism, -(-total // _LEAST_TOKENS)), -(-total // _PART_TOKENS), 1)
    dealt = texts.withColumn("slot", _slot(F.col("doc_id"), slots)).repartition(parts, "slot").sortWithinPartitions("slot", "doc_id")
    (
        _blocks(dealt, average, cfg)
        .withColumn("bucket", bucket_of(F.col("term")))
        .sortWithinPartitions("bucket", "term", "slot")
        .write.option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(f"{path}/segments/{name}/blocks")
    )
    return {"name": name, "n": n, "dl": total, "slots": slots, "average": average, "dead": [], "dead_n": 0, "dead_dl": 0}


def _write_texts(texts: DataFrame, path: str, name: str) -> None:
    texts.write.option("compression", "zstd").parquet(f"{path}/segments/{name}/texts")


def _dead(spark: SparkSession, path: str, segment: dict) -> DataFrame | None:
    """doc_id of the segment's replaced and deleted documents; None if there are none."""
    if not segment["dead_n"]:
        return None
    return spark.read.parquet(*(f"{path}/dead/{d}/docs" for d in segment["dead"])).select("doc_id")


def _living(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(broadcast_if_small(dead), "doc_id", "left_anti")


def add_batch(
    docs: DataFrame | None,
    doc: str,
    fields: list[str],
    path: str,
    batch: str,
    deleted: DataFrame | None = None,
    layout: Layout = Layout(),
    cfg: Settings = DEFAULT,
    spark: SparkSession | None = None,
) -> bool:
    """Index a batch of documents with distinct ids, replacing stored ones, and delete those of ``deleted``.

    False if the batch is part of the index already. Rows without an id are left out.
    """
    spark = spark or (docs if docs is not None else deleted).sparkSession
    number, state = read_state(spark, path)
    if batch in state.get("batches", ()):
        return False
    segments, name = [dict(s) for s in state.get("segments", ())], f"{number + 1:010d}"
    drop_folders(spark, [f"{path}/segments/{name}", f"{path}/dead/{name}"])  # of an attempt that was never committed
    gone = [] if deleted is None else [deleted.select(F.col(doc).alias("doc_id")).filter("doc_id IS NOT NULL")]
    made = []
    if docs is not None:
        spaced = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc_id"), F.trim(spaced_text(fields)).alias("text"))
        _write_texts(spaced.select("doc_id", T.spaced_count(F.col("text")).alias("dl"), "text"), path, name)
        made.append(_write_segment(spark, path, name, layout, cfg))
        gone.append(spark.read.parquet(f"{path}/segments/{name}/texts").select("doc_id"))
    ids = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
    ids = broadcast_if_small(materialise(ids.distinct(), "replaced"))
    for segment in segments:
        _bury(spark, path, segment, ids, name)
    batches = [*state.get("batches", ()), batch]
    live = [s for s in [*segments, *made] if s["n"] > s["dead_n"]] or [*segments, *made][-1:]
    commit(spark, path, number, {"segments": live, "batches": batches})
    return True


def _bury(spark: SparkSession, path: str, segment: dict, ids: DataFrame, name: str) -> None:
    """Tombstones for the segment's living documents among ``ids``, and the terms that they take along."""
    texts = spark.read.parquet(f"{path}/segments/{segment['name']}/texts")
    hit = _living(texts, _dead(spark, path, segment)).join(ids, "doc_id", "left_semi")
    folder = f"{name}/{segment['name']}"
    terms = F.array_distinct(F.filter(F.split("text", " "), lambda t: t != ""))
    hit.select("doc_id", "dl", terms.alias("terms")).write.option("compression", "zstd").parquet(f"{path}/dead/{folder}/docs")
    stored = spark.read.parquet(f"{path}/dead/{folder}/docs")
    totals = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    if totals["n"]:
        terms = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        terms.withColumn("bucket", bucket_of(F.col("term"))).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/dead/{folder}/terms")
        segment["dead"] = [*segment["dead"], folder]
        segment["dead_n"] += totals["n"]
        segment["dead_dl"] += totals["dl"]


def _class(segment: dict, fanout: int) -> int:
    return int(math.log(max(segment["n"] - segment["dead_n"], 1), fanout) + 1e-9)


def merge_tiers(spark: SparkSession, path: str, layout: Layout = Layout(), cfg: Settings = DEFAULT) -> list[str]:
    """Unite the segments of each size class that has ``fanout`` of them; the names of those united."""
    merged = []
    while True:
        number, state = read_state(spark, path)
        classes: dict[int, list[dict]] = {}
        for s in state.get("segments", ()):
            classes.setdefault(_class(s, layout.fanout), []).append(s)
        full = [v for _, v in sorted(classes.items()) if len(v) >= layout.fanout]
        if not full:
            return merged
        old, name = full[0], f"{number + 1:010d}"
        drop_folders(spark, [f"{path}/segments/{name}"])
        parts = [_living(spark.read.parquet(f"{path}/segments/{s['name']}/texts"), _dead(spark, path, s)) for s in old]
        texts = parts[0]
        for part in parts[1:]:
            texts = texts.unionByName(part)
        _write_texts(texts, path, name)
        made = _write_segment(spark, path, name, layout, cfg)
        kept = [s for s in state["segments"] if s not in old]
        commit(spark, path, number, {"segments": [*kept, made], "batches": state["batches"]})
        merged += [s["name"] for s in old]


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders of segments and tombstones that the last state does not name; call when no reader is left."""
    _, state = read_state(spark, path)
    jvm = spark._jvm
    live = {s["name"] for s in state.get("segments", ())}
    graves = {d for s in state.get("segments", ()) for d in s["dead"]}
    dropped = []
    for kind, depth in (("segments", 1), ("dead", 2)):
        found = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}" + "/*" * depth)
        for status in found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or ():
            folder = status.getPath()
            name = str(folder.getName()) if depth == 1 else f"{folder.getParent().getName()}/{folder.getName()}"
            if name not in (live if depth == 1 else graves):
                dropped.append(str(folder.toString()))
    drop_folders(spark, dropped)
    return len(dropped)


def _pushed(terms: DataFrame) -> Column | None:
    """A filter of stored rows by term for a small batch of terms, which scans can use; else None."""
    few = [r["term"] for r in terms.limit(PUSHED_TERMS + 1).collect()]
    if len(few) > PUSHED_TERMS:
        return None
    buckets = [r[0] for r in terms.select(bucket_of(F.col("term"))).distinct().collect()]
    return F.col("bucket").isin(buckets) & F.col("term").isin(few)


def _of_terms(stored: DataFrame, terms: DataFrame, pushed: Column | None) -> DataFrame:
    return stored.filter(pushed) if pushed is not None else stored.join(broadcast_if_small(terms), "term", "left_semi")


def _stored(spark: SparkSession, path: str) -> dict:
    _, state = read_state(spark, path)
    if not state.get("segments"):
        raise ValueError(f"no index at {path}")
    return state


def segment_hits(spark: SparkSession, path: str, terms: DataFrame) -> Hits:
    """Hits of a batch of terms in the living documents, for all searches that take hits."""
    state = _stored(spark, path)
    wanted = materialise(terms.select("term").distinct(), "terms")
    pushed = _pushed(wanted)
    found = None
    for s in state["segments"]:
        blocks = _of_terms(spark.read.parquet(f"{path}/segments/{s['name']}/blocks"), wanted, pushed)
        rows = _living(blocks.select("term", F.inline("entries")), _dead(spark, path, s))
        found = rows if found is None else found.unionByName(rows)
    hits = F.array_sort(F.collect_list(F.struct("term", "tf", "positions"))).alias("hits")
    per_doc = materialise(found.groupBy("doc_id", "dl").agg(hits), "hits")
    n, average = _totals(state)
    return Hits(per_doc, F.lit(n), F.lit(average), _document_frequency(per_doc))


def _totals(state: dict) -> tuple[int, float]:
    n = sum(s["n"] - s["dead_n"] for s in state["segments"])
    return n, sum(s["dl"] - s["dead_dl"] for s in state["segments"]) / max(n, 1)


@dataclass(frozen=True)
class Found:
    """The first documents, and the tables of slots read first and read after the bound was known."""

    top: DataFrame
    seeds: DataFrame
    needed: DataFrame
    bounds: DataFrame


def top_stored(
    spark: SparkSession, path: str, parsed: DataFrame, k: int, layout: Layout = Layout(), cfg: Settings = DEFAULT, seeds: int | None = None
) -> Found:
    """(query_id, doc_id, n_matched, score, rank): first k documents with at least one term of the query; exact.

    ``seeds`` slots per query are read to find the bound (default: k).
    """
    state = _stored(spark, path)
    n, average = _totals(state)
    wanted = materialise(S.terms_of(parsed), "terms")
    pushed = _pushed(wanted)
    # headers only: no postings are read here
    heads, dead = None, None
    for i, s in enumerate(state["segments"]):
        blocks = _of_terms(spark.read.parquet(f"{path}/segments/{s['name']}/blocks").select("bucket", "term", "slot", "n", "most"), wanted, pushed)
        stretch = max(1.0, average / s["average"])
        rows = blocks.select("term", F.lit(i).alias("segment"), "slot", "n", (F.col("most") * stretch).alias("most"))
        heads = rows if heads is None else heads.unionByName(rows)
        for d in s["dead"]:
            less = _of_terms(spark.read.parquet(f"{path}/dead/{d}/terms"), wanted, pushed).select("term", (-F.col("n")).alias("n"))
            dead = less if dead is None else dead.unionByName(less)
    heads = materialise(heads, "heads")
    counted = heads.select("term", F.col("n").cast("long").alias("n"))
    counts = (counted if dead is None else counted.unionByName(dead)).groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
    weights = parsed.select("query_id", F.explode("terms").alias("term")).join(broadcast_if_small(materialise(counts, "df")), "term")
    weights = materialise(weights.select("query_id", "term", S.idf(F.col("df"), F.lit(n), cfg).alias("idf")), "weights")
    small = broadcast_if_small(weights)
    bounds = heads.join(small, "term").groupBy("query_id", "segment", "slot").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    bounds = materialise(bounds, "bounds")
    first = top_per_group(bounds, ["query_id"], [F.desc("bound"), F.asc("segment"), F.asc("slot")], seeds or k, "slot").drop("rank")
    first = materialise(first, "seeds")

    def scored(slots: DataFrame) -> DataFrame:
        read = _read_slots(spark, path, state, slots, small, wanted, pushed, layout).withColumn("avg_dl", F.lit(average))
        return S._sums(read, cfg, ("segment", "slot")).drop("segment", "slot")

    best = materialise(scored(first), "seed-scores")
    kth = top_per_group(best, ["query_id"], S.best_first(), k, "doc_id").filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(broadcast_if_small(materialise(kth, "floor")), "query_id", "left")
    # bounds are compared with room for the rounding of scores
    rest = rest.filter(F.col("least").isNull() | (F.col("bound") + 1e-5 >= F.col("least")))
    needed = materialise(rest.join(first.select("query_id", "segment", "slot"), ["query_id", "segment", "slot"], "left_anti"), "needed")
    both = best.unionByName(scored(needed))
    return Found(S.top(both, k), first, needed, bounds)


def slot_ranges(numbers: list[int], width: int) -> Column:
    """A filter by ranges of slots: neighbouring bins of ``width`` slots are one range."""
    runs: list[list[int]] = []
    for b in sorted(numbers):
        if runs and runs[-1][1] == b:
            runs[-1][1] = b + 1
        else:
            runs.append([b, b + 1])
    found = F.lit(False)
    for a, b in runs:
        found = found | ((F.col("slot") >= a * width) & (F.col("slot") < b * width))
    return found


def _read_slots(
    spark: SparkSession, path: str, state: dict, slots: DataFrame, weights: DataFrame, wanted: DataFrame, pushed: Column | None, layout: Layout
) -> DataFrame:
    """(query_id, segment, slot, doc_id, dl, tf, idf) of the queries' postings in their slots.

    The scan of a segment gets the ranges that hold its slots, at most ``ranges``; the exact slots of each query follow by a join.
    """
    bins: dict[int, list[int]] = {}
    width = {i: -(-s["slots"] // layout.ranges) for i, s in enumerate(state["segments"])}
    widths = F.create_map(*(F.lit(x) for pair in width.items() for x in pair))
    for r in slots.select("segment", F.floor(F.col("slot") / F.element_at(widths, F.col("segment"))).alias("bin")).distinct().collect():
        bins.setdefault(r["segment"], []).append(r["bin"])
    rows = None
    for i, s in enumerate(state["segments"]):
        if i not in bins:
            continue
        blocks = _of_terms(spark.read.parquet(f"{path}/segments/{s['name']}/blocks"), wanted, pushed).filter(slot_ranges(bins[i], width[i]))
        read = blocks.select(F.lit(i).alias("segment"), "slot", "term", F.inline(F.transform("entries", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["dl"].alias("dl"), e["tf"].alias("tf")))))
        read = _living(read, _dead(spark, path, s))
        rows = read if rows is None else rows.unionByName(read)
    if rows is None:
        empty = spark.read.parquet(f"{path}/segments/{state['segments'][0]['name']}/blocks").filter("false")
        rows = empty.select(F.lit(0).alias("segment"), "slot", "term", F.inline("entries")).drop("positions")
    # a slot's postings meet once, before they multiply by the queries, and are summed there
    met = rows.repartition("segment", "slot")
    asked = slots.groupBy("segment", "slot").agg(F.collect_set("query_id").alias("_queries"))
    return (
        met.join(weights, "term")
        .join(asked, ["segment", "slot"])
        .filter(F.array_contains("_queries", F.col("query_id")))
        .drop("_queries")
    )
