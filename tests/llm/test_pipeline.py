import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pagelake.llm import catalog

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and result of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialise(stage(spark, docs, sf), "test")
        out.append((name, docs, kept))
        docs = kept
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stage_columns(stages):
    for _, docs, kept in stages[:-1]:
        assert kept.columns == docs.columns


def test_near_duplicate_stage_equals_brute_force(stages):
    _, docs, kept = stages[1]
    keep = {d for d, _, _, first in brute.near_duplicates(pairs(docs), 5, 80) if first}
    assert pairs(kept) == [(d, t) for d, t in pairs(docs) if d in keep] and len(keep) < docs.count()


def test_repeat_stage_equals_brute_force(stages):
    _, docs, kept = stages[2]
    want = {d: (n, gone) for d, n, gone, _ in brute.repeated_words(pairs(docs), 50)}
    texts = dict(pairs(docs))
    got = dict(pairs(kept))
    assert set(got) == {d for d, (n, gone) in want.items() if not gone or gone < n}
    for d, t in got.items():
        n, gone = want[d]
        assert t == texts[d] if not gone else len(brute.words(t)) == n - gone
    for r in kept.filter("n_chars <> length(text)").select("doc_id").collect():
        assert not want[r.doc_id][1]


def test_leak_stage_drops_documents_with_items(stages, spark, sf):
    _, docs, kept = stages[3]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {d for d, t in pairs(docs) if not any(i in t for i in items)}
    assert {d for d, _ in pairs(kept)} == left


def test_mixture_stage_equals_its_sql(stages, tmp_path):
    _, docs, kept = stages[4]
    docs.write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    want = con.sql(f"SELECT doc_id, tokens, copies FROM ({catalog.ORACLE['op6_token_budgets']})").fetchall()
    assert sorted((r.doc_id, r.tokens, r.copies) for r in kept.collect()) == sorted(want)


def test_toxicity_stage_keeps_clean_documents(stages, spark, sf):
    _, docs, kept = stages[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").count()
    assert kept.join(labels.filter("toxic = 0"), "doc_id").count() >= 0.97 * clean
    assert kept.join(labels.filter("toxic = 1"), "doc_id").count() <= 0.5 * docs.join(labels.filter("toxic = 1"), "doc_id").count()


def test_registered_once_per_operator():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


def test_odd_rows_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a b c", "en", "src1", 5), (2, "", "en", "", 0), (3, "x y z " * 30, "en", "src2", 180), (3, "x y z " * 30, "en", "src2", 180), (4, "p " * 30_000, "de", "src0", 60_000)]
    for name, table in (("documents", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "a b")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        assert sorted(str(r.doc_id) for r in docs.collect()) == (["1", "2", "3", "3", "4", "None"] if table else [])
        corpus_pipeline.run(spark, folder).count()
