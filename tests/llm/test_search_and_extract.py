import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import bestbin, consensus

VECTORS = "vec_id long, embedding array<float>, label int, leaf int, query_id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECTORS)


def exact(rows, k, divisor):
    ids = np.array([i for i, _ in rows])
    grid = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i in ids[ids % divisor == 0]:
        s = (grid * grid[ids == i][0]).sum(1)
        order = np.lexsort((ids, -s))
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != i][:k]
    return out


def got(spark, rows, shape, divisor):
    found = {}
    for r in bestbin.search(vectors(spark, rows), F.col("vec_id") % divisor == 0, shape).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def some_rows(seed, n=600, d=12):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(8, d))
    grid = centers[r.integers(8, size=n)] + r.normal(size=(n, d)) * 0.6
    grid[100:180] = grid[100]  # a common vector
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(grid)]


def test_all_visits_are_exact_and_ties_go_to_the_smaller_id(spark):
    rows = some_rows(1)
    assert got(spark, rows, bestbin.Shape(k=7, sample=300, leaf=20, recall=1.0, probes=1000, block=50), 10) == exact(rows, 7, 10)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_corpus(spark, folder):
    """At least 0.9 of the true neighbours, with the production shape."""
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, found = exact(rows, 20, 20), got(spark, rows, bestbin.Shape(), 20)
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in found[q]}) for q in want)
    assert set(found) == set(want) and hits >= 0.9 * sum(map(len, want.values()))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, []), (10, [-1.0, 0.0])]
    assert got(spark, rows, bestbin.Shape(), 10) == {0: [(1, 0.5), (8, 0.5), (8, 0.5), (10, -1.0)], 10: [(1, -0.5), (8, -0.5), (8, -0.5), (0, -1.0)]}
    assert got(spark, [], bestbin.Shape(), 10) == {} and got(spark, rows[:1], bestbin.Shape(), 10) == {}
    assert got(spark, [(1, [1.0])], bestbin.Shape(), 10) == {}


def test_rows_that_repeat_an_id_are_candidates_and_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 3.0]), (0, [0.0, 3.0]), (1, [2.0, 0.0]), (1, [1.0, 1.0])]
    found = bestbin.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, bestbin.Shape(k=3)).collect()
    want = []
    for i, (own, q) in enumerate(rows):
        if own % 10 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(rows) if n != i)[:3]
            want += [(own, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    assert sorted(map(tuple, found)) == sorted(want)


PAGES = "page_id long, url string, html string, host string, paths string, path string, text string"


def extract(spark, rows):
    made = consensus.main_text(spark.createDataFrame([(i, u, h, "h", "p", "q", "t") for i, u, h in rows], PAGES)).collect()
    assert all(r.n_chars == len(r.text) for r in made)
    return {r.page_id: r.text for r in made}


ARTICLE = """<html><head><title>no</title><style>p{}</style></head><body class="x1"><div class="site-header">no</div><nav>no</nav>
<div class="post post-17"><h1>Head &amp; line</h1><p>One <b>bold</b>word&nbsp;here <a href="/">link</a>.<br>More<p>Two &lt;b&gt; &#8364;<ul><li>a<li>b</ul>
<form>no<input></form><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><div class="ad">no</div><aside>no</aside><section class="comments"><p>no</section>
<p title="a > b">Last</p></div><div id="sidebar"><p>no no no no no no no no no no no no no no no no</p></div><div role="alert">no</div><footer>no</footer></body></html>"""


def test_article_text(spark):
    want = "Head & line\nOne boldword here link . More\nTwo <b> €\na\nb\nLast".replace("link .", "link.")
    assert extract(spark, [(1, "http://a.test/x", ARTICLE)])[1] == want


def test_class_words_of_themes_keep_the_article():
    """Class words of body, article or of what holds most of the text leave nothing out; boxes of whole names go."""
    inner = "<h1>Head</h1><p>Some text of the article</p><p>and more of it</p>"
    ads = '<div class="ad-slot">no</div><div class="widget_area left">no</div><p>in <span class="share">no</span>line</p><div id="comment-list-2">no</div>'
    want = "Head\nSome text of the article\nand more of it\nin line"
    for page in (
        f"<body class='single has-sidebar sidebar'><div>{inner}{ads}</div></body>",
        f"<body><article class='post comments-open comments'>{inner}{ads}</article></body>",
        f"<body><div id='content' class='social-science'>{inner}{ads}</div></body>",
        f"<body><div class='widget'>{inner}{ads}</div><div class='social-science'></div></body>",
    ):
        assert consensus.Page(page).text() == want and consensus.Page(page).scores()
    small = f"<body><div>{inner}<div class='social-science'>kept</div><div class='social'>no</div></div></body>"
    assert consensus.Page(small).text() == want.replace("in line", "kept")


def test_pages_follow_their_host(spark):
    """A page whose largest block is elsewhere still gives the container that its host agrees on."""
    plain = '<body><div class="story"><p>{}</p></div><div class="box"><p>x</p></div>'
    odd = '<body><div class="story"><p>short</p></div><div class="box"><p>' + "y " * 500 + "</p></div>"
    rows = [(i, "http://a.test/", plain.format("word " * 30)) for i in range(5)] + [(7, "http://a.test/7", odd), (8, "http://b.test/", odd)]
    got_ = extract(spark, rows)
    assert got_[7] == "short" and got_[8] == ("y " * 500).strip()


def test_each_template_of_a_host_keeps_its_own_path(spark):
    """On a host of many templates no page falls back to the body that they share."""
    page = '<body><div class="t{}"><p>{}</p></div><div class="box"><p>x</p></div></body>'
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(40)]
    rows = [(3 * i + k, f"http://a.test/{i}/{k}", page.format(n, f"{n}{k} " * 30)) for i, n in enumerate(names) for k in range(3)]
    rows.append((1000, "http://a.test/only", page.format("only", "only " * 30)))
    got_ = extract(spark, rows)
    assert all(got_[3 * i + k] == (f"{n}{k} " * 30).strip() for i, n in enumerate(names) for k in range(3))
    assert got_[1000] == ("only " * 30).strip()


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "no tags at all &amp; so"), (4, "x", "<p>a<p>b</div></p>c<a hre"), (5, "x", "<" * 50), (6, "http://a/", "<div>" * 3000 + "deep"), (6, "http://a/", "<div>" * 3000 + "deep"), (None, "y", "<p>z" + " q" * 200_000)]
    got_ = extract(spark, rows)
    assert got_[1] == got_[2] == "" and got_[3] == "no tags at all & so" and got_[4] == "a\nb\nc" and got_[6] == "deep" and len(got_[None]) == 400_001
    assert extract(spark, []) == {}


def test_article_of_the_corpus(spark, sf):
    """The made pages have one article element; a plain cut of it gives the same text."""
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r.text for r in consensus.main_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)^.*?<article>|</article>.*$", "", r.html)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert found[r.page_id] == "\n".join(p for p in want if p)


@pytest.mark.parametrize("page", ["<script " * 1_250_000, "<div " * 2_000_000, "<div>" * 100_000 + "</span>" * 100_000, "<!" * 2_000_000, '<span class="ad">' + "<div>" * 50_000 + "</span>" * 100_000, '</a ">" ' * 200_000, "<li>x<div>" * 50_000])
def test_broken_pages_take_linear_time(page):
    import time

    start = time.perf_counter()
    made = consensus.Page(page)
    made.votes(), made.text()
    assert time.perf_counter() - start < 20


def test_scan_equals_plain_patterns():
    """Random pieces of markup: the scan finds what one pattern without possessive parts finds."""
    import random
    import re

    plain = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S | re.I)
    pick = random.Random(5)
    pieces = ["<div>", "</div>", "<p x='", "</a \"", "<b ", "'", '"', ">", "<", "<!", "<!-- ", "-->", "</", "<script ", "</script>", "text ", "<a href=\"x>y\">", "<title>", "</title >", "€", "\U0001f600"]
    for _ in range(20_000):
        page = "".join(pick.choices(pieces, k=pick.randint(1, 25)))
        want = [(m.start(), m.end(), m[2] == "/", (m[3] or "").lower(), m[4] or "") for m in plain.finditer(page)]
        assert list(consensus.tags(page)) == want, page


def test_an_article_far_above_its_blocks_gets_the_whole_vote():
    page = consensus.Page("<body><article>" + "<div>" * 40 + "<p>deep text")
    assert len(page.path) == 44 and page.votes()[page.path[2]] == (2, 1.0)


def test_votes_by_brute_force(spark):
    """Paths written out in full, scores by walking up from every block, means by counting pages."""
    import random

    pick = random.Random(11)
    boxes = ["<div class=a>", "<div class=b>", "<section>", "<article>", "<main>"]
    bodies = ["".join(pick.choice(boxes) for _ in range(pick.randint(1, 14))) + "<p>" + "w " * pick.randint(1, 40) + "</p></div></section>" + "<p>x</p>" for _ in range(60)]
    rows = [(i, f"http://{'ab'[i % 2]}.test/{i}", b) for i, b in enumerate(bodies)]
    made = {i: consensus.Page(b) for i, _, b in rows}

    def full(page, e):
        return (full(page, page.parent[e]) + (page.path[e],)) if e else ()

    votes = {}
    for i, page in made.items():
        score = {full(page, e): 0.0 for e, t in enumerate(page.tag) if e == 0 or t in consensus._CONTAINER}
        for e, text, linked in page.blocks:
            share, nearest = 1.0, True
            while True:
                if e == 0 or page.tag[e] in consensus._CONTAINER:
                    share = 1.0 if nearest or page.tag[e] in ("article", "main") else share / 2
                    nearest = False
                    score[full(page, e)] += (len(text) - linked) * share
                if e == 0:
                    break
                e = page.parent[e]
        votes[i] = {p: round(1e6 * s / max(score.values())) for p, s in score.items() if s > 0}
    want = {}
    for i in votes:
        means = {p: [votes[j][p] for j in votes if j % 2 == i % 2 and p in votes[j]] for p in votes[i]}
        mean = {p: sum(v) / (len(v) + 1) for p, v in means.items()}
        key = {p: p[-1] if p else consensus.ROOT for p in mean}
        a = max(mean, key=lambda p: (mean[p], len(p), key[p]))
        b = max(votes[i], key=lambda p: (votes[i][p], len(p), key[p]))
        taken = b if votes[i][a] < 750_000 and mean[a] < 750_000 and b[: len(a)] == a else a
        want[i] = "\n".join(t for e, t, _ in made[i].blocks if full(made[i], e)[: len(taken)] == taken)
    assert extract(spark, rows) == want
