import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from pagelake.operators import index as I
from pagelake.operators import links as L
from pagelake.operators import ranked as K
from pagelake.operators import stats as A
from pagelake.operators import upsert as U
from pagelake.sources import pages as SRC
from pagelake.sources import store as ST


def test_link_share(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "from_url string, to_url string")
    shares = L.link_share(edges)
    assert {r.to_url: r.share for r in shares.collect()} == {"x": pytest.approx(2 / 3), "y": pytest.approx(1 / 3)}
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    assert L.link_share(edges.limit(0)).count() == 0


def test_frontier_order(spark):
    c = spark.createDataFrame([(1, "u1"), (0, "u2"), (5, "u1"), (0, "u3")], "priority int, url string")
    seen = spark.createDataFrame([("u3",)], "url string")
    got = L.next_urls(L.frontier(c, seen), 10).collect()
    assert [(r.priority, r.url) for r in got] == [(0, "u2"), (1, "u1")]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbering_of_a_hot_group(spark, parts):
    """One host holds most rows; the result does not depend on the partitions."""
    hot = spark.range(5000).select(F.lit("hot").alias("g"), F.xxhash64("id").alias("k"))
    rest = spark.range(40).select(F.concat(F.lit("g"), F.col("id") % 7).alias("g"), F.col("id").alias("k"))
    with_null = rest.unionByName(spark.sql("SELECT CAST(NULL AS string) AS g, 3L AS k"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = K.number_rows(hot.unionByName(with_null), ["g"], ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.k, r["rank"]))
    assert len(got) == 5041 and len(groups) == 9
    for pairs in groups.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_top_per_group_beyond_the_engine_limit(spark):
    df = spark.range(6000).select(F.lit("g").alias("g"), F.col("id"), (-F.col("id")).alias("v"))
    got = K.top_per_group(df, ["g"], [F.asc("v")], 1500, "id")
    assert sorted(r.id for r in got.collect()) == list(range(4500, 6000))
    many = df.withColumn("g", F.col("id") % 3)
    small = plan(K.top_per_group(many, ["g"], [F.asc("v")], 10, "id"))
    assert "WindowGroupLimit" in small


def test_timetable_delay(spark):
    waiting = spark.createDataFrame([("http://h.test/b", 0), ("http://h.test/a", 0), ("http://h.test/c", -1), ("http://o.test/", 3)], "url string, priority int")
    got = {r.url: r.start_s for r in L.fetch_timetable(waiting).collect()}
    assert got == {"http://h.test/c": 0.0, "http://h.test/a": 0.5, "http://h.test/b": 1.0, "http://o.test/": 0.0}


def brute_latency(values):
    y, out = 0.0, []
    for x in values:
        y = x * 0.9 + y * (1 - 0.9)
        out.append(y)
    return out


@pytest.mark.parametrize("chunk", [20, 37, 1000])
def test_smoothed_latency_in_chunks(spark, chunk):
    values = [((i * 7919) % 101) / 10 for i in range(500)]
    log = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("t", 0, 1.0), ("t", 1, 0.0), ("t", 2, 1.0)], "shard string, at int, value double")
    got = A.smoothed_latency(log, "shard", ["at"], "value", chunk=chunk)
    by = {(r.shard, r.at): r.smoothed for r in got.collect()}
    assert [by["s", i] for i in range(500)] == pytest.approx(brute_latency(values), abs=1e-12)
    assert [by["t", i] for i in range(3)] == pytest.approx([0.9, 0.09, 0.909])
    assert A.slow(got).filter("shard = 't'").count() == 2


def test_imbalance(spark):
    from dataclasses import replace

    from pagelake.config import DEFAULT

    stats = spark.createDataFrame([(0, 16), (1, 4), (2, 15), (3, 5)], "shard long, pages long")
    got = {r.pages: r.unbalanced for r in A.imbalance(stats, replace(DEFAULT, shard_count=4)).collect()}
    assert got == {16: True, 4: True, 15: False, 5: False}


def test_cache_retention_edge(spark):
    cache = spark.sql("SELECT 1 AS i, TIMESTAMP '2024-01-01 00:00:00' AS cached_at UNION ALL SELECT 2, TIMESTAMP '2023-12-31 23:59:59'")
    assert [r.i for r in A.keep_recent(cache, F.lit("2024-01-31 00:00:00").cast("timestamp")).collect()] == [1]


def test_upserts(spark):
    v = spark.createDataFrame([("u", 0, "t1", 0.9, False), ("u", 1, "t2", 0.3, True)], "url string, seq int, title string, score double, is_dangerous boolean")
    assert rows(U.replace_upsert(v, "url", ["seq"]), "url", "seq", "title") == [("u", 1, "t2")]
    merged = U.merge_upsert(v, "url", ["seq"], ["title", "score"], ["is_dangerous"], "seq")
    assert rows(merged, "title", "score", "is_dangerous", "seq") == [("t2", 0.3, False, 1)]
    reset = U.replace_into(v.withColumn("popularity", F.lit(9)), v.limit(1).withColumn("seq", F.lit(5)), "url", ["seq"])
    assert rows(reset, "seq", "popularity") == [(5, 0)]


def test_upsert_keeps_one_row_per_task_of_a_hot_key(spark):
    """The hot key is reduced before the shuffle."""
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    text = plan(U.replace_upsert(df, "k", ["id"]))
    assert text.count("Aggregate") >= 2 and "partial_max_by" in text


def test_store_round_trip_and_pruning(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = str(tmp_path / "store")
    ST.write_pages(pages.unionByName(spark.createDataFrame([(9, None, "x"), (8, "", "y")], pages.schema)), path)
    back = ST.read_pages(spark, path)
    assert rows(back, "page_id", "url", "html") == rows(pages, "page_id", "url", "html")
    assert "PartitionFilters: [isnotnull(shard" in plan(ST.read_pages(spark, path, 3))
    got = ST.read_query(spark, path, "SELECT count(*) AS n FROM {pages} WHERE url LIKE :u", {"u": "https%"}, shard=3)
    assert got.first().n == back.filter("shard = 3 AND url LIKE 'https%'").count()


def test_sitemaps(spark, tmp_path):
    xml = "<urlset><url><loc> http://a.test/1 </loc></url><url><loc>ftp://x/</loc></url><url><loc>https://a.test/2?a=1&amp;b=2</loc></url></urlset>"
    df = spark.createDataFrame([("a.test", xml)], "host string, xml string")
    assert rows(SRC.sitemap_urls(df), "loc") == [("http://a.test/1",), ("https://a.test/2?a=1&b=2",)]
    (tmp_path / "s.xml").write_text(xml)
    assert rows(SRC.read_sitemap_xml(spark, str(tmp_path / "s.xml")), "loc") == [("http://a.test/1",), ("https://a.test/2?a=1&b=2",)]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        assert ST.shared_folder(spark) == named.rstrip("/")


def test_intermediate_tables_are_dropped(spark, tmp_path):
    before = ST.materialise(spark.range(3), "gone")
    assert before.count() == 3 and ST.drop_intermediates(spark) >= 1
    assert ST.drop_intermediates(spark) == 0


def test_size_check(spark):
    assert ST.is_small(spark.range(10))
    assert not ST.is_small(spark.range(10), max_rows=9)
    assert not ST.is_small(spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t")), max_bytes=5000)


def test_stored_index_reads_its_terms_only(spark, tmp_path):
    """Buckets of other terms are pruned as folders and the terms reach the scan."""
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} common") for i in range(300)], "doc_id long, text string")
    I.write_index(docs, "doc_id", ["text"], str(tmp_path / "i"))
    terms = spark.createDataFrame([("w7",), ("w8",)], "term string")
    found = I.read_postings(spark, str(tmp_path / "i"), terms)
    text = plan(found)
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term, [" in text
    assert sorted((r.term, r.doc_id) for r in found.collect()) == [("w7", 6), ("w7", 7), ("w8", 7), ("w8", 8)]


def test_scanned_hits_cross_one_exchange(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    hits = I.scan_hits(docs, "doc_id", I.tokens_of(["text"]), spark.createDataFrame([("a",)], "term string"))
    assert [(r.doc_id, r.dl, [tuple(h) for h in r.hits]) for r in hits.docs.collect()] == [(1, 3, [("a", 2)])]
    assert docs.select(hits.n_docs.alias("n"), hits.avg_dl.alias("a")).first() == (2, 2.0)
