from dataclasses import replace
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.config import DEFAULT
from pagelake.functions import keys, urls

BASE = "http://h.test/a/b?x=1"
FIXTURE = [
    ("https://o.test/p", "https://o.test/p", True),
    ("//o.test/p", "http://o.test/p", True),
    ("/p", "http://h.test/p", True),
    ("c", "http://h.test/a/c", True),
    ("../c", "http://h.test/c", True),
    ("?y=2", "http://h.test/a/b?y=2", True),
    ("#f", "http://h.test/a/b?x=1#f", True),
    ("", BASE, True),
    ("mailto:a@b", "mailto:a@b", False),
    ("javascript:void(0)", "javascript:void(0)", False),
]


def resolve(spark, pairs):
    df = spark.createDataFrame(list(pairs), "base string, href string")
    return [r.u for r in df.select(urls.resolve(F.col("base"), F.col("href")).alias("u")).collect()]


def test_resolve_fixture(spark):
    df = spark.createDataFrame([(BASE, h) for h, _, _ in FIXTURE], "base string, href string")
    out = df.select("href", urls.resolve(F.col("base"), F.col("href")).alias("u"))
    got = {r.href: (r.u, r.web) for r in out.withColumn("web", urls.is_web(F.col("u"))).collect()}
    assert got == {h: (u, w) for h, u, w in FIXTURE}


HARD = [
    "./x/../y/", "..", ".", "/a/../../b", "c//d", "HTTP://Q.test/x", "http:c", ";x", "  /p", "a\nb", "/x/./y",
    "g?y#s", "/p?q=/../z", "../../../g", "./", "x/", "?", "//o.test", "a/./b/../c?d=../e",
]


@pytest.mark.parametrize("base", [BASE, "http://h.test", "http://h.test/", "http://h.test/a/b/", "https://u@h.test:8/a//b/c;p?q#f"])
def test_resolve_like_standard_library(spark, base):
    assert resolve(spark, [(base, h) for h in HARD]) == [urljoin(base, h) for h in HARD]


segment = st.sampled_from(["a", "b.html", ".", "..", "", "c;p", "d=e", "%20"])
path = st.lists(segment, max_size=6).map("/".join)
href = st.builds(
    lambda lead, p, q, f: lead + p + q + f,
    st.sampled_from(["", "/", "//o.test/", "https://s.test/"]), path,
    st.sampled_from(["", "?q=1"]), st.sampled_from(["", "#t"]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(href, min_size=60, max_size=120))
def test_resolve_random(spark, hrefs):
    hrefs = [h for h in hrefs if not h.startswith("///")]
    assert resolve(spark, [(BASE, h) for h in hrefs]) == [urljoin(BASE, h) for h in hrefs]


def test_netloc_keeps_user_port_and_case(spark):
    texts = ["http://u:p@H.Test:80/x", "//n.test?q", "mailto:a@b", "/p", "", "https://x.test#f"]
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    assert [r.n for r in df.select(urls.netloc(F.col("u")).alias("n")).collect()] == [urlparse(t).netloc for t in texts]


def test_flags_quirks_and_strict_mode(spark):
    df = spark.createDataFrame([("http://evilgithub.com/download",)], "u string")
    host = urls.netloc(F.col("u"))
    strict = replace(DEFAULT, strict=True)
    row = df.select(
        urls.is_trusted(host).alias("t"), urls.is_ad(F.col("u")).alias("a"),
        urls.is_trusted(host, strict).alias("ts"), urls.is_ad(F.col("u"), strict).alias("as_"),
    ).first()
    assert (row.t, row.a, row.ts, row.as_) == (True, True, False, False)


def test_shards_equal_whole_number_modulo(spark):
    import hashlib

    texts = [f"http://h{i}.test/é" for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    for n in (1, 7, 16, 100, 256):
        got = [r.s for r in df.select(keys.shard_of_url(F.col("u"), n).alias("s")).collect()]
        assert got == [int(hashlib.sha256(t.encode()).hexdigest(), 16) % n for t in texts]
