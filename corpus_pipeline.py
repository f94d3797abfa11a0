"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it for the next.
All stages but the last return the columns of documents. A document of several equal rows is kept or
dropped in all of them, but for exact copies: of rows that repeat id and text all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import budget, catalog, neardup, superkmer, templates, toxicity
from pagelake.sources.store import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the hash by which the operators name a row's text."""
    return docs.select(*COLUMNS, F.xxhash64("text").alias("key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the toxicity classifier predicts; it learns from the labels of all rows it is given."""
    shape = toxicity.Shape()
    labels = catalog.table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select(*COLUMNS, F.col("text").alias("kept_text")), toxicity.train(docs, labels, shape), shape)
    return scored.filter(F.col("score") < shape.threshold).select(*(F.col("kept_text").alias("text") if c == "text" else F.col(c) for c in COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: sets of five-word shingles, 80 % alike."""
    found = neardup.near_duplicates(docs, neardup.Shape(shingle=5, percent=80))
    gone = found.filter("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the 50-word windows that an earlier document holds; documents without a word left go."""
    cut = superkmer.repeated_words(docs, with_text=True).filter("n_removed > 0").select("doc_id", "key", "left_text").dropDuplicates(["doc_id", "key"])
    rows = _keyed(docs).join(cut, ["doc_id", "key"], "left").filter("left_text IS NULL OR left_text <> ''")
    text = F.coalesce("left_text", "text")
    chars = F.when(F.col("left_text").isNull(), F.col("n_chars")).otherwise(F.length("left_text").cast("long"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage, as written or re-parameterised."""
    found = templates.contaminated(docs, catalog.table(spark, sf_dir, "benchmark"))
    gone = found.select("doc_id", "key").distinct()
    return _keyed(docs).join(gone, ["doc_id", "key"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that reach the mixture's weights, with their domain, tokens and copies."""
    taken = budget.select_tokens(catalog.with_domain(docs), catalog.MIXTURE)
    taken = taken.groupBy("doc_id", "key", "domain", "tokens").agg(F.max("copies").alias("copies"))
    rows = _keyed(docs).withColumn("id", F.struct("doc_id"))  # a struct compares null ids as equal
    return rows.join(taken.withColumn("id", F.struct("doc_id")).drop("doc_id"), ["id", "key"]).select(*COLUMNS, "domain", "tokens", "copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated windows", cut_repeats),
    ("benchmark leaks", drop_benchmark_leaks),
    ("source mixture", mix_sources),
]

#: The classifier, signatures and connected components of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLE: dict[str, str] = {}
