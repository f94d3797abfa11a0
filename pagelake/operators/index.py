"""Inverted index: postings, term statistics, and the hits of a batch of terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagelake.functions import stem as S
from pagelake.functions import text as T
from pagelake.functions.runs import runs, text_slices
from pagelake.sources.store import broadcast_if_small, is_small, materialise


def _posting_rows(docs: DataFrame, text: str) -> DataFrame:
    """(other columns, dl, term, tf, positions) for the tokens of a column of spaced tokens, null for none."""
    keep = [c for c in docs.columns if c != text]
    kinds = StructType([StructField(c, docs.schema[c].dataType) for c in keep] + [StructField("dl", LongType())])
    made = StructType.fromDDL("term string, tf long, positions array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            found = runs(batch.column(text))
            rows = pa.array(found.row)
            columns = [*(batch.column(c).take(rows) for c in keep), pa.array(found.dl[found.row]), found.term, pa.array(found.tf), found.positions()]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "dl", "term", "tf", "positions"])

    return docs.mapInArrow(run, StructType([*kinds, *made]))


def postings(docs: DataFrame, doc: str, fields: list[str], fold_accents: bool = False) -> DataFrame:
    """(doc, field, term, tf, positions). Narrow: each document counts its own terms."""
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), T.spaced_tokens(F.col(f), fold_accents).alias("_text")) for f in fields])
    return _posting_rows(docs.select(doc, F.inline(per_field)), "_text").drop("dl")


def document_lengths(docs: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    return docs.select(doc, token_count(fields).alias("dl"))


def tokens_of(fields: list[str], fold_accents: bool = False) -> Column:
    return F.concat(*[T.index_tokens(F.coalesce(F.col(f), F.lit("")), fold_accents) for f in fields])


def spaced_text(fields: list[str], fold_accents: bool = False) -> Column:
    """The tokens of ``tokens_of`` as one text with spaces between them."""
    return T.spaced_tokens(F.concat_ws(" ", *[F.col(f) for f in fields]), fold_accents)


def token_count(fields: list[str]) -> Column:
    return F.size(tokens_of(fields)).cast("long")


def term_statistics(post: DataFrame, doc: str) -> DataFrame:
    """Documents and occurrences per term; counts are partial before the shuffles."""
    per_doc = post.groupBy("term", doc).agg(F.sum("tf").alias("tf")) if "field" in post.columns else post
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """(term, stem) for the distinct terms only; join it back to stem an index."""
    return terms.select("term").distinct().withColumn("stem", S.porter_stem(F.col("term")))


def stem_postings(post: DataFrame, doc: str) -> DataFrame:
    """Postings by stem. They are written before, so that texts are read once for the vocabulary and the join;
    the vocabulary is stemmed once and broadcast while it is small."""
    post = materialise(post, "postings")
    vocabulary = broadcast_if_small(materialise(stem_vocabulary(post), "vocabulary"))
    stemmed = post.join(vocabulary, "term").groupBy(doc, "field", "stem")
    return stemmed.agg(
        F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")
    ).withColumnRenamed("stem", "term")


@dataclass(frozen=True)
class Hits:
    """Per document, its occurrences of the searched terms; plus corpus statistics.

    ``docs``: (doc_id, dl, hits array<struct<term, tf, positions>>).
    """

    docs: DataFrame
    n_docs: Column
    avg_dl: Column
    df: DataFrame  # (term, df)


def _document_frequency(docs: DataFrame) -> DataFrame:
    terms = docs.select(F.explode("hits.term").alias("term"))
    return materialise(terms.groupBy("term").agg(F.count("*").alias("df")), "df")


def scan_hits(
    docs: DataFrame,
    doc: str,
    tokens: Column,
    terms: DataFrame,
    extra_terms: Column | None = None,
    positions: bool = False,
) -> Hits:
    """Find a batch of terms in raw documents, in one pass over the text.

    The texts are read once, in Arrow batches that keep the searched tokens only: a table of one row per
    document, with its length and its hits, is written and serves the statistics too, so a repeated task cannot
    count twice. The only exchange is by document, and documents without any searched term are not sent.
    A batch of terms too large for a task's memory is joined with the exploded tokens instead.
    ``extra_terms`` are searchable but do not count in the document length (prefix terms).
    ``positions`` keeps where each term stands, for phrases.
    """
    wanted = materialise(terms.select("term").distinct(), "terms")
    searchable = F.col("_tokens") if extra_terms is None else F.concat("_tokens", extra_terms)
    read = docs.select(F.col(doc).alias("doc_id"), tokens.alias("_tokens"))
    length = F.size("_tokens").cast("long").alias("dl")
    if is_small(wanted):
        rows = materialise(_found_in(read.select("doc_id", length, F.array_join(searchable, " ").alias("_text")), wanted), "scanned")
        lists = rows.filter(F.size("hits") > 0).groupBy("doc_id", "dl").agg(F.collect_list("hits").alias("found"))
        places = F.transform(F.flatten("found"), lambda h: F.transform(h["positions"], lambda p: F.struct(h["term"].alias("term"), p.alias("pos"))))
        # rows that repeat a document are one document
        hits = F.when(F.size("found") == 1, F.get("found", F.lit(0))).otherwise(T.runs_of(F.flatten(places)))
        found, stats = lists, rows.agg(F.count("*").alias("n"), F.avg("dl").alias("a"))
    else:
        occurrences = read.select("doc_id", length, F.posexplode(searchable).alias("pos", "term")).join(wanted, "term")
        found = occurrences.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", "pos")).alias("found"))
        hits, stats = T.runs_of(F.col("found")), read.agg(F.count("*").alias("n"), F.avg(F.size("_tokens")).alias("a"))
    if not positions:
        hits = F.transform(hits, lambda h: F.struct(h["term"].alias("term"), h["tf"].alias("tf")))
    per_doc = materialise(found.select("doc_id", "dl", hits.alias("hits")), "hits")
    row = materialise(stats, "statistics")
    return Hits(per_doc, row.select("n").scalar(), row.select("a").scalar(), _document_frequency(per_doc))


def _found_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, dl, hits) of every row of (doc_id, dl, _text), a text of spaced tokens."""
    terms = docs.sparkSession.sparkContext.broadcast([r["term"] for r in wanted.collect()])
    hit = "array<struct<term: string, tf: bigint, positions: array<int>>>"
    schema = StructType([*docs.schema.fields[:2], StructField("hits", StructType.fromDDL(f"h {hit}")["h"].dataType)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = pa.array(terms.value, pa.string())
        for batch in text_slices(batches, "_text"):
            found = runs(batch.column("_text"), only)
            items = pa.StructArray.from_arrays([found.term, pa.array(found.tf), found.positions()], ["term", "tf", "positions"])
            ends = np.concatenate(([0], np.cumsum(np.bincount(found.row, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dl"), pa.ListArray.from_arrays(pa.array(ends), items)], ["doc_id", "dl", "hits"])

    return docs.mapInArrow(run, schema)


# Folders of a stored index, and the batch size up to which the terms themselves are pushed to the scan.
BUCKETS, PUSHED_TERMS = 64, 2000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, doc: str, fields: list[str], path: str) -> None:
    """Store postings and corpus statistics.

    Postings lie in one folder per term bucket, each file sorted by (term, document). The
    rebalance hint cuts a large bucket into many tasks by size, without a sampling pass over
    the texts.
    """
    combined = docs.select(F.col(doc).alias("doc_id"), spaced_text(fields).alias("_text"))
    rows = _posting_rows(combined, "_text").withColumn("bucket", bucket_of(F.col("term")))
    (
        rows.hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    combined.agg(
        F.count("*").alias("n_docs"), F.avg(T.spaced_count(F.col("_text"))).alias("avg_dl")
    ).write.parquet(f"{path}/statistics")


def read_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """Stored postings of the given terms: folders of other buckets are not listed, and of a
    small batch the terms reach the scan, which skips row groups by their term range."""
    wanted = terms.select("term").distinct()
    post = spark.read.parquet(f"{path}/postings")
    few = [r["term"] for r in wanted.limit(PUSHED_TERMS + 1).collect()]
    if len(few) <= PUSHED_TERMS:
        buckets = [r[0] for r in wanted.select(bucket_of(F.col("term"))).distinct().collect()]
        return post.filter(F.col("bucket").isin(buckets) & F.col("term").isin(few)).drop("bucket")
    return post.drop("bucket").join(broadcast_if_small(wanted), "term")


def read_hits(spark: SparkSession, path: str, terms: DataFrame) -> Hits:
    """Hits of a batch of terms from a stored index."""
    per_doc = (
        read_postings(spark, path, terms)
        .groupBy("doc_id", "dl")
        .agg(F.array_sort(F.collect_list(F.struct("term", "tf", "positions"))).alias("hits"))
    )
    per_doc = materialise(per_doc, "hits")
    stats = spark.read.parquet(f"{path}/statistics")
    return Hits(
        per_doc, stats.select("n_docs").scalar(), stats.select("avg_dl").scalar(), _document_frequency(per_doc)
    )
