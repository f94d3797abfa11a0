import html as pyhtml

import random
import re
import time

import pytest
from helpers import plan
from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.operators import links as L
from pagelake.operators.media import media
from pagelake.operators.safety import analyze, findings
from pagelake.operators.sanitize import add_snippet, remove_unwanted, sanitize
from pagelake.plans import crawl as C

PAGES = "page_id long, url string, html string, headers map<string,string>"
ROW5 = '<img src="https://ad.doubleclick.net/i.gif">'
BAD_SCRIPT = '<script>atob("x")</script>'
SAFETY = [
    ("http://a.test/x", "<p>hello</p>", None, 1.0, [], False),
    ("http://a.test/x", BAD_SCRIPT, None, 0.3, ["malicious_script"], True),
    ("http://a.test/x", '<script src="http://www.google-analytics.com/a.js"></script>', None, 0.76, ["insecure_script"], False),
    ("http://a.test/x", '<a href="/download">d</a>', None, 0.9, [], False),
    ("http://a.test/x", ROW5, None, 0.72, [], False),
    ("http://a.test/x", ROW5 + '<meta http-equiv="refresh">', None, 0.648, ["meta_refresh"], True),
    ("https://evilgithub.com/", BAD_SCRIPT, None, 1.0, ["trusted_domain"], False),
    ("http://a.test/x", '<a href="/download">d</a>', {"Strict-Transport-Security": "max-age=1"}, 0.945, [], False),
    ("http://a.test/x", BAD_SCRIPT * 2, None, 0.09, ["malicious_script", "malicious_script"], True),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, m) for i, (u, h, m) in enumerate(rows)], PAGES)


def test_safety_fixture(spark):
    done = analyze(frame(spark, [r[:3] for r in SAFETY])).orderBy("page_id").collect()
    for got, (_, _, _, score, threats, dangerous) in zip(done, SAFETY):
        assert got.score == pytest.approx(score, abs=1e-12)
        assert (got.threats, got.sandbox_required, got.injection_script is not None) == (threats, dangerous, dangerous)


def test_findings_follow_the_source_order(spark):
    page = (
        '<a href="https://x.criteo.com/">1</a><img src="https://y.criteo.com/"><iframe src="//z.criteo.com/ad"></iframe>'
        '<script src="http://w.criteo.com/"></script>' + BAD_SCRIPT + '<meta http-equiv="refresh">'
    )
    got = findings(analyze(frame(spark, [("http://a.test/", page, None)]))).orderBy("kind", "position").collect()
    by_kind = {}
    for r in got:
        by_kind.setdefault(r.kind, []).append(r.value)
    assert by_kind["trackers"] == ["w.criteo.com", "z.criteo.com", "y.criteo.com", "x.criteo.com"]
    assert by_kind["threats"] == ["malicious_script", "insecure_script", "meta_refresh"]
    assert by_kind["ads"] == ["//z.criteo.com/ad"]
    assert by_kind["scripts"] == [BAD_SCRIPT]


def test_each_tracker_lowers_the_score(spark):
    parts = ["<p>a</p>", ROW5, ROW5 + '<img src="//t.taboola.com/x">']
    scores = [r.score for r in analyze(frame(spark, [("http://a.test/", p, None) for p in parts])).orderBy("page_id").collect()]
    assert all(0 <= s <= 1 for s in scores) and scores == sorted(scores, reverse=True)


SANITISE = [
    ('<img src="https://x.taboola.com/a"><p>k</p>', "<p>k</p>"),
    ('<img class="header" src="/a">', ""),
    ('<div class="ad">k</div>', '<div class="ad">k</div>'),
    ('a<script src="//c.pubmatic.com/x">t()</script>b<link href="//c.pubmatic.com/x">c', "abc"),
    ("<!-- <img src='//x.criteo.com/'> -->k", "<!-- <img src='//x.criteo.com/'> -->k"),
    ("no markup", "no markup"),
    ("", ""),
]


def test_sanitise_fixture_and_idempotence(spark):
    df = spark.createDataFrame(SANITISE, "html string, want string")
    once = remove_unwanted(F.col("html"))
    for r in df.select("want", once.alias("got"), remove_unwanted(once).alias("twice")).collect():
        assert r.got == r.want == r.twice


def test_snippet_placement(spark):
    texts = ["<html><head><t></head><b>", "<html lang='x'><body>", "bare"]
    df = spark.createDataFrame([(t,) for t in texts], "html string")
    got = [r.s for r in df.select(add_snippet(F.col("html"), F.lit("$1\\S")).alias("s")).collect()]
    assert got == ["<html><head><t>$1\\S</head><b>", "<html lang='x'><head>$1\\S</head><body>", "<head>$1\\S</head>bare"]


def test_snippet_is_not_put_into_scripts_or_comments(spark):
    page = "<!-- <html></head> --><html><head><script>var t='</head>';</script><title></head></title></head><b>"
    got = spark.createDataFrame([(page,)], "html string").select(add_snippet(F.col("html"), F.lit("S")).alias("s")).first().s
    assert got == page.replace("</title></head>", "</title>S</head>")


def test_cut_off_and_very_long_tags(spark):
    texts = ['<a href="/x">y</a><a title="' + "b" * 300_000, "<a " + "c " * 200_000, "<a " + 'x="1" ' * 50_000 + 'href="/l">z', "<p it's>k</p>"]
    df = spark.createDataFrame([(t,) for t in texts], "html string")
    rows = df.select(H.elements(F.col("html")).alias("e"), H.page_text(F.col("html")).alias("t")).collect()
    assert [[e.href for e in r.e] for r in rows] == [["/x"], [], ["/l"], []]
    assert rows[2].t == "z" and rows[3].t == "k" and rows[0].t.startswith("y <a")


def test_unsafe_page_gets_the_snippet(spark):
    df = analyze(frame(spark, [("http://a.test/", "<html><head></head>" + BAD_SCRIPT, None), ("http://a.test/", "<html><head></head>", None)]))
    got = [r.clean_html for r in sanitize(df).orderBy("page_id").collect()]
    assert got[0].index("localStorage") < got[0].index("</script></head>")
    assert got[1] == "<html><head></head>"


def test_text_title_and_entities(spark):
    page = (
        "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><nav>n</nav><!-- c -->"
        "<p>x<b>y\n  z</p><script>if (a<b) {}</script><footer>&copy; f</footer>1 < 2</body></html>"
    )
    df = spark.createDataFrame([("http://h.test/", page), ("http://h.test/t", "<title></title>&eacute;&#8364;")], "url string, html string")
    got = df.select(
        H.title(F.col("html"), F.col("url")).alias("title"),
        H.page_text(F.col("html")).alias("text"),
        H.page_text(F.col("html"), H.INDEX_DROP).alias("index_text"),
    ).collect()
    assert got[0].title == "A & B" and got[1].title == "http://h.test/t"
    assert got[0].text == "A & B x y z 1 < 2"
    assert got[0].index_text == "A & B n x y z © f 1 < 2"
    assert got[1].text == pyhtml.unescape("&eacute;&#8364;")


def test_entities_like_standard_library(spark):
    texts = [
        "a &amp;lt; b &lt;i&gt; &eacute;&Eacute; &#8217;&#x20AC;&#X1F600; &#39;&apos; &#150;&#0039;", "&bogus; & &; &#; &#x; x&", "&#xD800; &#0; &#1114112; &#99999999999;",
        "&rarr;&hellip;&mdash;", "plain", "", "&#x000000041;&#" + "0" * 60 + "65; &#x110000000041;", "&copy 2024 &ampx &notin &eacutes &#65 &#x42g &AMP",
    ]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r.d for r in df.select(H.decode_entities(F.col("t")).alias("d")).collect()]
    assert got == [pyhtml.unescape(t) for t in texts] + [None]
    space = spark.createDataFrame([("a&nbsp;b&#160;c",)], "t string").select(H.decode_entities(F.col("t")).alias("d"))
    assert space.first().d == "a\u00a0b\u00a0c"


def test_attributes(spark):
    tag = "<IMG data-src=no ALT='a \"src=x\" b' src = \"/p?a&amp;b\" width=10 height hidden>"
    df = spark.createDataFrame([(tag + "<a href>e</a>",)], "html string")
    img, a = df.select(H.elements(F.col("html")).alias("e")).first().e
    assert (img.tag, img.src, img.alt, img.width, img.height, img.href) == ("img", "/p?a&b", 'a "src=x" b', "10", "", None)
    assert a.href == ""


def test_media(spark):
    page = (
        '<img src="/i.png" width="5"><img alt="no source"><video src="v.mp4" poster="/p.png"></video><audio><source src="s.mp3" poster="x"></audio>'
        '<iframe src="//www.youtube.com/e"></iframe><video src="w.mp4"></video>'
    )
    df = spark.createDataFrame([("http://h.test/d/", page)], "url string, html string")
    m = df.select(media(H.elements(F.col("html")), F.col("url")).alias("m")).first().m
    assert [(i.url, i.alt, i.width, i.height) for i in m.images] == [("http://h.test/i.png", "", "5", None)]
    assert [(v.url, v.poster, v.embed) for v in m.videos] == [
        ("http://h.test/d/v.mp4", "/p.png", None), ("http://h.test/d/s.mp3", None, None),
        ("http://h.test/d/w.mp4", None, None), ("//www.youtube.com/e", None, True),
    ]


def test_links_skip_boilerplate_and_unsafe_pages(spark):
    page = '<nav><a href="/n">n</a></nav><a href="/a">1</a><a href="/a">2</a><a href="mailto:x@y">m</a><a href="">s</a>'
    unsafe = page + BAD_SCRIPT
    df = frame(spark, [("http://h.test/p", page, None), ("http://h.test/q", unsafe, None)])
    assert sorted(r.to_url for r in L.edges(df.filter("page_id = 0")).collect()) == ["http://h.test/a", "http://h.test/p"]
    assert L.edges(df, include_boilerplate=True).filter("to_url = 'http://h.test/n'").count() == 2
    assert {r.from_url for r in C.crawl(df).links.collect()} == {"http://h.test/p"}


def test_page_stage_has_no_shuffle(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    text = plan(C.stored_pages(C.analysed_pages(pages)))
    assert "Exchange" not in text and "Python" not in text


def test_only_needed_columns_are_read(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    text = plan(L.sites_to_discover(pages.filter("url like 'https:%'")))
    assert "struct<url:string>" in text and "StringStartsWith(url,https:)" in text


NESTED = [
    ("<nav>a<nav>b</nav>c</nav>d", "d", "a b c d"),
    ("<nav>a<nav>b</nav>c", "a c", "a b c"),  # the outer one is never closed
    ("</nav>a<NAV class='x'>b</Nav >c</nav>d<nav>e", "a c d e", "a b c d e"),
    ("<footer>a<nav>b</footer>c</nav>d<navy>e</navy>", "c d e", "a b c d e"),
    ("x<nav>a<script>'</nav>'</script>b<!-- </nav> -->c</nav>y<nav>z</nav>", "x y", "x a b c y z"),
    ("<nav>" * 40 + "a" + "</nav>" * 40 + "b", "b", "a b"),
    ("<script>a<b>c<style>d</style>e<!-- f<script>g</script>h", "h", "h"),
    ("a<!-- b<style>c<p>d</style>e<script>f<i>g", "a<!-- b e f g", "a<!-- b e f g"),
    ("a<b>c<", "a c<", "a c<"), ("a < b <", "a < b <", "a < b <"), ("<!-->a--><p>b", "b", "b"), ("", "", ""), (None, None, None),
]


def test_nested_and_unclosed_blocks(spark):
    df = spark.createDataFrame([(i, h, *w) for i, (h, *w) in enumerate(NESTED)], "i int, html string, outside string, inside string")
    got = df.select("i", "html", "outside", "inside", H.page_text(F.col("html")).alias("o"), H.page_text(F.col("html"), H.INDEX_DROP).alias("n"), F.array_join(H.pieces(F.col("html")), "").alias("again"))
    for r in got.collect():
        assert (r.o, r.n) == (r.outside, r.inside), r.html
        assert r.again == r.html


def plain_cut(text, tag):
    """Outermost balanced blocks by a stack of openers."""
    parts = re.split(rf"(</?{tag}>)", text)
    stack, ranges = [], []
    for i, p in enumerate(parts):
        if p == f"<{tag}>":
            stack.append(i)
        elif p == f"</{tag}>" and stack:
            ranges.append((stack.pop(), i))
    gone = {k for a, b in ranges for k in range(a, b + 1)}
    return "".join("" if i in gone or p.startswith("<") else p for i, p in enumerate(parts))


def test_balanced_blocks_equal_a_stack(spark):
    r = random.Random(2)
    pages = ["".join(r.choice(["<nav>", "</nav>", "</nav>", "<nav>", "a", "b"]) for _ in range(r.randint(0, 30))) for _ in range(200)]
    pages.append("".join(r.choice(["<nav>", "</nav>", "k"]) for _ in range(3000)))
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = [r.t.replace(" ", "") for r in df.select(H.page_text(F.col("html")).alias("t")).collect()]
    assert got == [plain_cut(p, "nav") for p in pages]


def test_links_of_nested_menus(spark):
    page = '<nav><a href="/1">1</a><nav><a href="/2">2</a></nav><a href="/3">3</a></nav><a href="/4">4</a>'
    df = frame(spark, [("http://h.test/p", page, None)])
    assert [r.to_url for r in L.edges(df).collect()] == ["http://h.test/4"]


def test_the_scan_is_linear_in_the_page(spark):
    """Megabytes of openers that nothing closes take seconds, not hours."""
    size = 2_000_000
    kinds = ("<script>", "<script ", "<!--", "<nav>", "<!-- <style><iframe>", "<nav></nav>x", "<a href='")
    df = spark.createDataFrame([(k,) for k in kinds], "k string").repartition(4)
    big = df.select("k", F.expr(f"repeat(k, int({size} / length(k)))").alias("html"))
    took = {}
    for kind in kinds:
        start = time.perf_counter()
        big.filter(F.col("k") == kind).select(F.sum(F.length(H.page_text(F.col("html")))), F.sum(F.size(H.tokens(F.col("html"))))).collect()
        took[kind] = time.perf_counter() - start
    assert max(took.values()) < 60, took
