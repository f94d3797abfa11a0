import random

import pytest
from helpers import plan
from pyspark.sql import functions as F

from pagelake.operators import index as I
from pagelake.operators import search as S
from pagelake.operators import segments as SEG
from pagelake.sources import pages as SRC
from test_search import WORDS, brute, brute_top

TEXTS = {1: "Sun, moon; sun", 2: None, 3: "", 4: "Été — été rock", 5: " the  the ", 6: "sea"}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def counted(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {(w, words.count(w), tuple(i for i, x in enumerate(words) if x == w)) for w in words}


def test_postings_are_made_in_batches_and_not_in_lambdas(spark):
    found = I.postings(frame(spark, TEXTS), "doc_id", ["text"])
    assert "regexp_extract_all" not in plan(found) and "Exchange" not in plan(found)
    got = {(r.doc_id, r.field, r.term, r.tf, tuple(r.positions)) for r in found.collect()}
    assert got == {(d, "text", *c) for d, t in TEXTS.items() for c in counted(t)}


def test_stems_read_stored_postings(spark):
    text = plan(I.stem_postings(I.postings(frame(spark, TEXTS), "doc_id", ["text"]), "doc_id"))
    assert "regexp" not in text and "MapInArrow" not in text


def test_scan_keeps_rows_that_repeat_a_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b a c"), (None, "a"), (2, "c"), (3, None)], "doc_id long, text string")
    hits = I.scan_hits(docs, "doc_id", I.tokens_of(["text"]), spark.createDataFrame([("a",), ("b",)], "term string"), positions=True)
    got = {r.doc_id: (r.dl, [(h.term, h.tf, h.positions) for h in r.hits]) for r in hits.docs.collect()}
    assert got == {1: (3, [("a", 3, [0, 1, 2]), ("b", 2, [0, 1])]), None: (1, [("a", 1, [0])])}
    assert docs.select(hits.n_docs.alias("n"), hits.avg_dl.alias("a")).first() == (5, 8 / 5)


@pytest.mark.parametrize("gain", [0, 10**6])
def test_top_any_by_shard_whether_pruning_pays_or_not(spark, gain):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for i in range(60)}
    queries = {0: "sun moon", 1: "the", 2: "rock nowhere"}
    parsed = S.parse(spark.createDataFrame(list(queries.items()), "query_id long, query string"))
    hits = I.scan_hits(frame(spark, docs), "doc_id", I.tokens_of(["text"]), S.terms_of(parsed))
    got = S.top_any(parsed, hits, 2, shard=F.col("doc_id") % 3, n_shards=3, plain_rows=0, slack=1, gain=gain)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == brute_top(brute((docs, queries), "any"), 2, lambda d: d % 3)


def test_blocks_are_made_where_the_texts_of_a_slot_lie(spark, monkeypatch):
    monkeypatch.setattr(SEG, "_TURNED", 1)
    rows = [(i, 3, f"the w{i % 4} the", i % 7) for i in range(80)]
    dealt = spark.createDataFrame(rows, "doc_id long, dl long, text string, slot long").repartition(2, "slot").sortWithinPartitions("slot", "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        made = SEG._blocks(dealt, 3.0, SEG.DEFAULT)
        assert plan(made).count("Exchange") <= 1 and "Aggregate" not in plan(made)
        got = {(r.term, r.slot): [(e.doc_id, e.dl, e.tf, e.positions) for e in r.entries] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, dl, _, slot in rows:
        want.setdefault(("the", slot), []).append((i, dl, 2, [0, 2]))
        want.setdefault((f"w{i % 4}", slot), []).append((i, dl, 1, [1]))
    assert got == want


def test_pages_of_one_row_group_are_many_tasks(spark, sf, monkeypatch):
    whole = SRC.read_pages(spark, f"{sf}/pages.parquet", "page_id")
    monkeypatch.setattr(SRC, "PAGE_TASK", 1000)
    many = SRC.read_pages(spark, f"{sf}/pages.parquet", "page_id")
    assert many.rdd.getNumPartitions() > 2 * whole.rdd.getNumPartitions() and many.count() == whole.count()
