import pytest
from helpers import rows
from pyspark.sql import functions as F

from pagelake.operators import links as L
from pagelake.plans import crawl as C
from pagelake.plans.catalog import ENRICHED
from pagelake.sources import commits
from pagelake.sources import pages as SRC
from pagelake.sources import snapshots as SNAP
from pagelake.streaming import ingest as STR


@pytest.fixture()
def folder(spark, sf, tmp_path):
    """The pages in several files, one file per micro-batch."""
    pages = spark.sql(ENRICHED, pages=spark.read.parquet(f"{sf}/pages.parquet"))
    path = str(tmp_path / "in")
    pages.repartitionByRange(3, "page_id").write.parquet(path)
    return path


def test_ingest_equals_batch(spark, folder, tmp_path):
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    stream = SRC.stream_pages(spark, folder, files_per_batch=1).withColumn("seq", F.col("page_id"))
    query = STR.ingest(stream, store, state)
    query.awaitTermination()
    batch = C.stored_pages(C.analysed_pages(spark.read.parquet(folder)))
    columns = ("url", "title", "content", "security_score", "is_dangerous", "keywords")
    assert rows(STR.current_pages(spark, store, ["seq"]), *columns) == rows(batch, *columns)
    one = STR.current_pages(spark, store, ["seq"], shard=5)
    assert rows(one, "url") == rows(STR.current_pages(spark, store, ["seq"]).filter("shard = 5"), "url")
    # a second run finds nothing new; a newer version of a page wins
    STR.ingest(stream, store, state).awaitTermination()
    newer = spark.read.parquet(folder).filter("page_id = 0").withColumn("html", F.lit("<title>new</title>"))
    newer.write.mode("append").parquet(folder)
    STR.ingest(stream, store, state).awaitTermination()
    current = STR.current_pages(spark, store, ["seq"])
    assert current.filter("title = 'new'").count() == 1 and current.count() == batch.count()
    STR.compact(spark, store, str(tmp_path / "compact"), ["seq"])
    assert rows(STR.current_pages(spark, str(tmp_path / "compact"), ["seq"]), "url", "title") == rows(current, "url", "title")


def test_running_summary(spark, folder, tmp_path):
    stream = SRC.stream_pages(spark, folder, files_per_batch=1)
    STR.running_summary(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    hosts = STR.host_counts(spark.read.parquet(folder))
    got = STR.newest_summary(spark, str(tmp_path / "s")).first()
    assert (got.pages_crawled, got.domains_count) == (hosts.agg(F.sum("pages")).first()[0], hosts.count())


def test_summary_of_many_hosts_is_one_row_of_bounded_size(spark, tmp_path):
    """Three batches of overlapping hosts: the estimate is near, and a repeated batch does not count twice."""
    path, target = str(tmp_path / "in"), str(tmp_path / "s")
    hosts = spark.range(0, 60_000, 1, 3).select((F.col("id") % 40_000).alias("h"))
    hosts.select(F.concat(F.lit("http://h"), "h", F.lit(".test/p")).alias("url"), F.lit("x").alias("html")).write.parquet(path)
    stream = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(path)
    STR.running_summary(stream, target, str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.groupBy("epoch").count().filter("count > 1").count() == 0 and stored.select("epoch").distinct().count() == 3
    got = STR.newest_summary(spark, target).first()
    assert got.pages_crawled == 60_000 and abs(got.domains_count - 40_000) < 0.02 * 40_000
    assert stored.select(F.max(F.octet_length("hosts"))).first()[0] < 20_000


def test_batches_merge_into_the_shards_they_touch(spark, tmp_path):
    path = str(tmp_path / "store")

    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store" / "data").rglob("part-*")}

    def batch(rows_):
        return spark.createDataFrame(rows_, "url string, html string, seq long")

    def stored():
        return rows(SNAP.read_snapshot(spark, path), "url", "html", "seq")

    first = [(f"http://h{i}.test/", f"a{i}", 1) for i in range(200)]
    assert len(SNAP.merge_batch(batch(first), path, 0, ["seq"])) == 16
    before = files()
    new = [("http://h7.test/", "b", 2), ("http://h7.test/", "older", 1), ("http://h9.test/", "stale", 0), (None, "x", 1)]
    touched = SNAP.merge_batch(batch(new), path, 1, ["seq"])
    assert 1 <= len(touched) <= 2
    want = sorted({u: (u, h, s) for u, h, s in [*first, new[0]]}.values())
    assert stored() == want
    assert before.items() <= files().items()  # old snapshots stay for their readers
    after = files()
    assert SNAP.merge_batch(batch(new), path, 1, ["seq"]) == [] and files() == after  # a repeated batch
    assert SNAP.vacuum(spark, path) == len(touched) and stored() == want
    kept = {f: t for f, t in before.items() if not any(f"shard={s}/" in f for s in touched)}
    assert kept.items() <= files().items() and len(kept) >= 14
    # a batch that died before its commit leaves a folder that no state names, and is written again
    number, _ = commits.read_state(spark, path)
    batch([("http://h1.test/", "half", 9)]).withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(f"{path}/data/v={number + 1}")
    assert stored() == want
    SNAP.merge_batch(batch([("http://h1.test/", "c", 1)]), path, 2, ["seq"])  # of equal versions the later batch
    assert stored() == sorted([*(r for r in want if r[0] != "http://h1.test/"), ("http://h1.test/", "c", 1)])
    shard = SNAP.read_snapshot(spark, path).filter("url = 'http://h1.test/'").first().shard
    one = SNAP.read_snapshot(spark, path, shard)
    assert rows(one, "url") == [(u,) for u in sorted(r.url for r in SNAP.read_snapshot(spark, path).filter(F.col("shard") == shard).collect())]
    assert all(f"shard={shard}" in f for f in one.inputFiles())
    with pytest.raises(ValueError):
        SNAP.read_snapshot(spark, str(tmp_path / "none"))


def test_frontier_grows_once_per_address(spark, folder, tmp_path):
    target = str(tmp_path / "f")
    STR.grow_frontier(SRC.stream_pages(spark, folder, files_per_batch=1), target, str(tmp_path / "c")).awaitTermination()
    crawl = C.crawl(spark.read.parquet(folder))
    assert rows(STR.waiting_urls(spark, target), "url") == rows(crawl.waiting, "url")
    queued = spark.read.parquet(target).filter("not crawled")
    assert queued.count() == queued.select("url").distinct().count()


def test_duplicates_return_after_the_cache_time(spark, tmp_path):
    """The same page at 0, 30 minutes and 5 hours; a later row moves the watermark on."""
    path = str(tmp_path / "in")
    schema = "page_id long, url string, html string, fetched_at timestamp"
    for i, (page, second) in enumerate([("a", 0), ("a", 1800), ("z", 14000), ("a", 18000)]):
        df = spark.createDataFrame([(i, page, "x", second)], "page_id long, url string, html string, s long")
        df.withColumn("fetched_at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        STR.store_stream(STR.once_per_hour(stream, "fetched_at"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [p for (p,) in rows(spark.read.parquet(str(tmp_path / "out")), "page_id")] == [0, 2, 3]


def test_status_filter(spark):
    df = spark.createDataFrame([("a", 200), ("b", 404)], "url string, status int")
    assert rows(SRC.fetched(df), "url") == [("a",)]
    assert SRC.fetched(df.drop("status")).count() == 2


def test_choose_sitemaps(spark):
    c = SRC.sitemap_candidates(spark.createDataFrame([("http://a.test/x",), ("http://b.test/",), ("http://c.test/",), ("http://a.test/y",)], "url string"))
    f = spark.createDataFrame(
        [("http://a.test/sitemap.xml", 200, "A"), ("http://b.test/sitemap.xml", 404, ""), ("http://b.test/sitemap_index.xml", 200, "B"), ("http://c.test/sitemap.xml", 500, "")],
        "url string, status int, xml string",
    )
    assert rows(SRC.choose_sitemaps(c, f), "site", "xml") == [("http://a.test", "A"), ("http://b.test", "B")]
    sites = L.sites_to_discover(spark.createDataFrame([("https://a.test/x",), ("http://a.test/y",)], "url string"))
    assert rows(sites, "site_url") == [("http://a.test",)]
