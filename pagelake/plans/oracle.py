"""The registered queries as SQL for a second engine, written as plain relational
queries (unnest, join, group) and not as the row-local forms the engine runs."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

from pagelake import config as K
from pagelake.functions import literal_alternation as alternation
from pagelake.functions import stem as S
from pagelake.functions import text as T
from pagelake.functions import urls as U
from pagelake.plans import catalog as C
from pagelake.sources.pages import LOC as SRC_LOC


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def half_up(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@lru_cache(maxsize=4)
def stop_words(languages: tuple[str, ...]) -> str:
    """SQL list of the stop words in the Spark ML jar."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jar = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))[0]
    words: set[str] = set()
    with zipfile.ZipFile(jar) as z:
        for language in languages:
            words.update(z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split("\n"))
    return ", ".join(q(w.strip()) for w in sorted(words) if w.strip())


ENRICHED = C.ENRICHED.format(pages="pages")
CRAWL_LOG = C.CRAWL_LOG.format(pages="pages")


# --- patterns of this side, written for an engine without possessive loops --------
INSIDE = r"""[^>=]*(?:=(?:\s*(?:"[^"]*"|'[^']*'))?[^>=]*)*"""
TAGS = ("script", "iframe", "a", "img", "video", "source", "link", "meta")
ATTRIBUTES = ("src", "href", "class", "alt", "width", "height", "poster", "http-equiv")
NAME_VALUE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def whole(*names: str) -> str:
    return "|".join(rf"<{n}\b{INSIDE}>.*?</{n}\s*>" for n in names)


UNSEEN = "<!--.*?-->|" + whole("script", "style", "iframe")
MARK = rf"(?is){UNSEEN}|<[A-Za-z]{INSIDE}>"
CRAWL_DROP, INDEX_DROP = ("script", "style", "nav", "footer"), ("script", "style")

# --- expressions --------------------------------------------------------------
# the entities that occur in the tables, ampersand last
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"),
)


def decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def decode_text(x: str) -> str:
    """In text the old names count without a semicolon too; chr(1) keeps a decoded ampersand apart."""
    for name, char in ENTITIES:
        x = f"replace({x}, {q(name)}, {'chr(1)' if char == '&' else q(char)})"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("copy", "\u00a9"), ("middot", "\u00b7"), ("amp", "&")):
        x = f"replace({x}, {q('&' + name)}, {q(char)})"
    return f"replace({x}, chr(1), '&')"


def netloc(x: str) -> str:
    return f"coalesce(regexp_extract({x}, {q(U.NETLOC)}, 1), '')"


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, {q(U.SCHEME)}, 1))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


TRACKER = alternation(K.TRACKER_DOMAINS)
AD = alternation(K.AD_WORDS)


def is_tracker(url: str) -> str:
    return matches(netloc(url), TRACKER)


def is_ad(x: str) -> str:
    return matches(f"lower({x})", AD)


def is_web(x: str) -> str:
    return f"({scheme(x)} IN ('http', 'https') AND {netloc(x)} <> '')"


def shard(digest: str) -> str:
    return f"CAST(('0x' || right({digest}, 1))::INT AS BIGINT)"


def attribute(name: str) -> str:
    at = f"list_position(an, {q(name)})"
    v = f"coalesce(av[{at}], '')"
    bare = f"CASE WHEN starts_with({v}, '\"') OR starts_with({v}, '''') THEN substr({v}, 2, length({v}) - 2) ELSE {v} END"
    return f"CASE WHEN {at} > 0 THEN {decode(bare)} END"


def page_text(x: str, drop: tuple[str, ...]) -> str:
    bare = f"regexp_replace({x}, {q(rf'(?is)<!--.*?-->|{whole(*drop)}|</?[A-Za-z]{INSIDE}>|<![A-Za-z][^>]*>')}, ' ', 'g')"
    return decode_text(f"trim(regexp_replace({bare}, {q('[ \\t\\r\\n\\f]+')}, ' ', 'g'))")


def title(x: str, url: str = "url") -> str:
    seen = f"regexp_extract_all({x}, {q('(?is)' + UNSEEN + '|' + whole('title'))})"
    first = f"list_filter({seen}, lambda t: starts_with(lower(t), '<title'))[1]"
    text = f"regexp_extract({first}, {q(rf'(?is)^<title{INSIDE}>(.*)</title')}, 1)"
    return f"coalesce(nullif({decode_text(text)}, ''), {url})"


def resolve(base: str, href: str) -> str:
    """The address forms that occur in the tables; the rest is covered by unit tests."""
    part = {n: f"regexp_extract({base}, {q(U.PARTS)}, {i})" for i, n in enumerate(("s", "n", "p", "q", "f"), 1)}
    site = f"{part['s']} || '://' || {part['n']}"
    query = f"CASE WHEN {part['q']} <> '' THEN '?' || {part['q']} ELSE '' END"
    return f"""CASE WHEN {href} = '' THEN {base}
      WHEN {matches(href, U.SCHEME)} THEN {href}
      WHEN starts_with({href}, '//') THEN {part['s']} || ':' || {href}
      WHEN starts_with({href}, '/') THEN {site} || {href}
      WHEN starts_with({href}, '?') THEN {site} || {part['p']} || {href}
      WHEN starts_with({href}, '#') THEN {site} || {part['p']} || {query} || {href}
      ELSE {site} || regexp_replace({part['p']}, '[^/]*$', '') || {href} END"""


# --- shared subqueries --------------------------------------------------------
def elements(src: str, name: str = "els", key: str = "page_id") -> str:
    tags = ", ".join(q(t) for t in TAGS)
    attrs = ", ".join(
        f"{attribute(a)} AS {'css' if a == 'class' else a.replace('-', '_')}" for a in ATTRIBUTES
    )
    return f"""{name} AS (
  SELECT {key}, url, pos, tag, raw, {attrs},
         nullif(regexp_extract(raw, {q(rf'(?is)^<script{INSIDE}>(.*)</script')}, 1), '') AS script_text
  FROM (SELECT *, regexp_extract_all(lower(ot), {q(NAME_VALUE)}, 1) AS an, regexp_extract_all(ot, {q(NAME_VALUE)}, 2) AS av
        FROM (SELECT *, lower(regexp_extract(raw, {q('^<([A-Za-z][A-Za-z0-9:-]*)')}, 1)) AS tag, regexp_extract(raw, {q(rf'^<[A-Za-z]{INSIDE}>')}) AS ot
              FROM (SELECT {key}, url, unnest(tl) AS raw, CAST(generate_subscripts(tl, 1) - 1 AS BIGINT) AS pos
                    FROM (SELECT {key}, url, regexp_extract_all(html, {q(MARK)}) AS tl FROM {src})))
        WHERE tag IN ({tags})))"""


def addresses(els: str = "els", key: str = "page_id") -> str:
    return f"""addr AS (
  SELECT {key}, url, pos, CASE tag WHEN 'script' THEN 1 WHEN 'iframe' THEN 2 WHEN 'img' THEN 3 ELSE 4 END AS grp,
         CASE WHEN tag = 'a' THEN href ELSE src END AS u
  FROM {els} WHERE tag IN ('script', 'iframe', 'img', 'a') AND CASE WHEN tag = 'a' THEN href ELSE src END <> '')"""


MALICIOUS = "(?i)" + "|".join(f"(?:{p})" for p in K.MALICIOUS_PATTERNS)


def safety(src: str, key: str = "page_id", trusted: tuple[str, ...] = K.TRUSTED_DOMAINS, hsts: str = "false") -> list[str]:
    """els, addr and saf(key, url, score, counts...)."""
    return [
        elements(src, key=key),
        addresses(key=key),
        f"""sc AS (SELECT {key}, count(*) FILTER (tag = 'script' AND {matches('script_text', MALICIOUS)}) AS m,
         count(*) FILTER (tag = 'script' AND starts_with(src, 'http:')) AS i,
         coalesce(bool_or(tag = 'meta' AND http_equiv = 'refresh'), false) AS r FROM els GROUP BY 1)""",
        f"""ac AS (SELECT {key}, count(*) FILTER ({is_tracker('u')}) AS t, count(*) FILTER ({is_ad('u')}) AS a FROM addr GROUP BY 1)""",
        f"""raw AS (SELECT p.{key}, p.url, p.html, {matches(netloc('p.url'), f"(?:{alternation(trusted)})$")} AS ok, {hsts} AS hsts,
         coalesce(m, 0) AS m, coalesce(i, 0) AS i, coalesce(t, 0) AS t, coalesce(a, 0) AS a, coalesce(r, false) AS r
         FROM {src} p LEFT JOIN sc ON sc.{key} = p.{key} LEFT JOIN ac ON ac.{key} = p.{key})""",
        f"""scored AS (SELECT *, pow(0.3e0, m) * pow(0.8e0, t) * pow(0.9e0, a) * pow(0.95e0, i) AS s0 FROM raw)""",
        f"""saf AS (SELECT *, score < 0.7e0 AS unsafe FROM (SELECT *, CASE WHEN ok THEN 1e0 ELSE
         (CASE WHEN hsts THEN least(1e0, s0 * 1.05e0) ELSE s0 END) * (CASE WHEN r THEN 0.9e0 ELSE 1e0 END) END AS score FROM scored))""",
    ]


BAD = f"""(tag IN ('script', 'iframe', 'img', 'link') AND (coalesce({is_tracker("coalesce(nullif(src, ''), href)")}, false)
   OR coalesce({is_ad('css')}, false)))"""


def cleaned(key: str = "page_id") -> list[str]:
    """clean(key, url, html, clean_html, ...) from saf and els."""
    snippet = q(K.PROTECTION_SNIPPET)
    at = "strpos(lower(h), '</head>')"
    return [
        f"bad AS (SELECT {key}, list(raw) AS raws FROM els WHERE {BAD} GROUP BY 1)",
        f"""cut AS (SELECT s.*, CASE WHEN raws IS NULL THEN html ELSE list_reduce(raws, lambda acc, x: replace(acc, x, ''), html) END AS h
         FROM saf s LEFT JOIN bad ON bad.{key} = s.{key})""",
        f"""clean AS (SELECT *, CASE WHEN NOT unsafe THEN h
          ELSE substr(h, 1, {at} - 1) || {snippet} || substr(h, {at}) END AS clean_html FROM cut)""",
    ]


def links(src: str, html: str = "html", where: str = "true", boilerplate: bool = False, name: str = "edge", key: str = "page_id") -> list[str]:
    body = html if boilerplate else f"regexp_replace({html}, {q('(?is)<!--.*?-->|' + whole(*CRAWL_DROP))}, ' ', 'g')"
    return [
        f"{name}_src AS (SELECT {key}, url, {body} AS html FROM {src} WHERE {where})",
        elements(f"{name}_src", f"{name}_els", key),
        f"""{name} AS (SELECT DISTINCT {key}, from_url, to_url FROM (SELECT {key}, url AS from_url, {resolve('url', 'href')} AS to_url
          FROM {name}_els WHERE tag = 'a' AND href IS NOT NULL) WHERE {is_web('to_url')})""",
    ]


def safe_links() -> list[str]:
    return [f"en AS ({ENRICHED})", *safety("en"), *cleaned(), *links("clean", "clean_html", "NOT unsafe")]


QUERIES = "qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def tokens(x: str, pattern: str = T.INDEX_TOKEN) -> str:
    return f"regexp_extract_all(lower({x}), {q(pattern)})"


def bm25(src: str, doc: str, text: str, queries: str = "qs", query: str = "query", name: str = "m") -> list[str]:
    """qt(query_id, term), tf(doc_id, term, tf), m(query_id, doc_id, n_matched, score)."""
    return [
        f"dt AS (SELECT {doc} AS doc_id, {text} AS toks FROM {src})",
        "dl AS (SELECT doc_id, len(toks) AS dl FROM dt)",
        "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL)",
        "st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl)",
        "df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)",
        f"qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens(query)}) AS term FROM {queries}))",
        *weights("qt", name),
    ]


def weights(qt: str, name: str) -> list[str]:
    idf = "greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6)"
    w = f"{idf} * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))"
    return [
        f"""{name} AS (SELECT query_id, doc_id, n_matched, {half_up('s')} AS score FROM (
  SELECT query_id, doc_id, count(*) AS n_matched, sum({w}) AS s
  FROM {qt} JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL))"""
    ]


ALL_TERMS = "(SELECT query_id, count(*) AS nt FROM qt GROUP BY 1)"
MATCH_ALL = f"m2 AS (SELECT query_id, doc_id, score FROM m JOIN {ALL_TERMS} USING (query_id) WHERE n_matched = nt)"


def top(src: str, k: int, columns: str, part: str = "query_id", low: int = 0) -> str:
    return f"""SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, doc_id) AS rank
  FROM {src}) WHERE rank <= {k} AND rank > {low}"""


FREQUENT = f"""qs AS (SELECT item_id AS query_id, array_to_string(list_transform(list_sort(list_transform(list_distinct({tokens('text')}),
  lambda t: {{'n': length(t), 't': t}}))[1:3], lambda x: x.t), ' ') AS query FROM benchmark)"""
PHRASES = f"qs AS (SELECT item_id AS query_id, array_to_string({tokens('text')}[1:2], ' ') AS query FROM benchmark)"
DOCS_ALL = [FREQUENT, *bm25("documents", "doc_id", tokens("text"))]
LEFT_DOCS = "left_docs AS (SELECT * FROM documents WHERE doc_id % 11 <> 0)"
DOCS_ANY = [QUERIES, *bm25("documents", "doc_id", tokens("text"))]
DOCS_TOP = [*DOCS_ANY, f"tops AS ({top('m', C.TOP_K, 'query_id, doc_id, score')})"]


def page_fields(src: str = "pages") -> list[str]:
    """pf(page_id, url, title, content) from sanitised pages."""
    return [
        *safety(src), *cleaned(),
        f"pf AS (SELECT *, {title('clean_html')} AS title, {page_text('clean_html', CRAWL_DROP)} AS content FROM clean)",
    ]


def keyword_rows(src: str, key: str, text: str) -> list[str]:
    """kw(key, word, n, rank)."""
    pattern = T.KEYWORD_TOKEN % 3
    return [
        f"kt AS (SELECT {key}, {tokens(text, pattern)} AS toks FROM {src})",
        f"kp AS (SELECT {key}, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM kt)",
        f"kc AS (SELECT {key}, word, count(*) AS n, min(pos) AS first FROM kp WHERE word NOT IN ({stop_words(('french', 'english'))}) GROUP BY ALL)",
        f"kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS rank FROM kc) WHERE rank <= 50)",
    ]


def field_postings(fields: dict[str, str], src: str = "pf") -> str:
    parts = " UNION ALL ".join(f"SELECT page_id, {q(f)} AS field, {tokens(x)} AS toks FROM {src}" for f, x in fields.items())
    return f"""occ AS (SELECT page_id, field, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM ({parts}))"""


POSITIONS = "string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions"


# consonants, vowels and the measure of the paper; a first y is a consonant
CONS, VOW = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
START = f"^(?:{CONS}{VOW}|[aeiou]+)"
M_1, M_2, M_IS_1 = f"{START}{CONS}", f"{START}{CONS}{VOW}{CONS}", f"{START}{CONS}(?:{VOW})?$"
VOWEL = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"
CVC = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"


def porter(src: str) -> str:
    """(term, stem) of a table of terms, one select layer per step."""

    def stem(w: str, n: int) -> str:
        return f"left({w}, length({w}) - {n})"

    def case(w: str, rules: list[tuple[str, str]]) -> str:
        return "CASE " + " ".join(f"WHEN ends_with({w}, {q(s)}) THEN {r}" for s, r in rules) + f" ELSE {w} END"

    def tidy(s: str) -> str:
        short = f"({matches(s, M_IS_1)} AND {matches(s, CVC)})"
        double = matches(s, "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$")
        return (
            f"CASE WHEN {matches(s, '(?:at|bl|iz)$')} THEN {s} || 'e' WHEN {double} THEN {stem(s, 1)} "
            f"WHEN {short} THEN {s} || 'e' ELSE {s} END"
        )

    def table(rules, w: str = "w") -> str:
        return case(w, [(s, f"CASE WHEN {matches(stem(w, len(s)), M_1)} THEN {stem(w, len(s))} || {q(n)} ELSE {w} END") for s, n in rules])

    def step_4() -> str:
        rules = []
        for s in S.STEP_4:
            ok = matches(stem("w", len(s)), M_2)
            if s == "ion":
                ok += " AND " + matches(stem("w", 3), "[st]$")
            rules.append((s, f"CASE WHEN {ok} THEN {stem('w', len(s))} ELSE w END"))
        return case("w", rules)

    def vowel_cut(n: int) -> str:
        s = stem("w", n)
        return f"CASE WHEN {matches(s, VOWEL)} THEN {tidy(s)} ELSE w END"

    e = stem("w", 1)
    layers = [
        case("w", [("sses", stem("w", 2)), ("ies", stem("w", 2)), ("ss", "w"), ("s", stem("w", 1))]),
        case("w", [("eed", f"CASE WHEN {matches(stem('w', 3), M_1)} THEN {stem('w', 1)} ELSE w END"), ("ed", vowel_cut(2)), ("ing", vowel_cut(3))]),
        f"CASE WHEN ends_with(w, 'y') AND {matches(e, VOWEL)} THEN {e} || 'i' ELSE w END",
        table(S.STEP_2), table(S.STEP_3), step_4(),
        f"""CASE WHEN ends_with(w, 'e') AND ({matches(e, M_2)} OR ({matches(e, M_IS_1)} AND NOT {matches(e, CVC)})) THEN {e} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {matches('w', M_2)} THEN {e} ELSE w END",
    ]
    sql = f"SELECT term, term AS w FROM {src}"
    for layer in layers:
        sql = f"SELECT term, {layer} AS w FROM ({sql})"
    return f"SELECT term, CASE WHEN length(term) > 2 AND {matches('term', '^[a-z]+$')} THEN w ELSE term END AS stem FROM ({sql})"


def tfidf(hits: str, queries: str = "qs") -> list[str]:
    """sim(query_id, doc_id, similarity) of hits (query_id, doc_id, corpus)."""
    pattern = T.KEYWORD_TOKEN % 2
    return [
        f"""cx AS (SELECT query_id, CAST(doc_id AS BIGINT) AS doc_id, corpus FROM {hits}
         UNION ALL SELECT query_id, NULL, query FROM {queries} WHERE query_id IN (SELECT query_id FROM {hits}))""",
        f"""ct AS (SELECT query_id, doc_id, term, count(*) AS tf FROM (SELECT query_id, doc_id, unnest({tokens('corpus', pattern)}) AS term FROM cx)
         WHERE term NOT IN ({stop_words(('english',))}) GROUP BY ALL)""",
        "cn AS (SELECT query_id, count(*) AS n FROM cx GROUP BY 1)",
        """cv AS (SELECT * FROM (SELECT query_id, term, count(*) AS df, 0 AS unused
         FROM ct GROUP BY query_id, term))""",
        "cw AS (SELECT query_id, doc_id, term, tf * (ln((1e0 + n) / (1e0 + df)) + 1e0) AS w FROM ct JOIN cv USING (query_id, term) JOIN cn USING (query_id))",
        "cq AS (SELECT query_id, term, w AS qw FROM cw WHERE doc_id IS NULL)",
        "cqn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM cq GROUP BY 1)",
        "cd AS (SELECT query_id, doc_id, sum(w * coalesce(qw, 0e0)) AS dot, sqrt(sum(w * w)) AS dn FROM (SELECT * FROM cw WHERE doc_id IS NOT NULL) LEFT JOIN cq USING (query_id, term) GROUP BY ALL)",
        f"sim AS (SELECT query_id, doc_id, coalesce(dot / (dn * qn), 0e0) AS similarity FROM {hits} LEFT JOIN cd USING (query_id, doc_id) LEFT JOIN cqn USING (query_id))",
    ]


def candidates() -> list[str]:
    """cand(url, priority) and fr(url, priority): the queue without crawled pages."""
    return [
        f"en AS ({ENRICHED})",
        *links("pages", boilerplate=True, name="le"), *links("en", name="lf"),
        """cand AS (SELECT to_url AS url, 0 AS priority FROM le UNION ALL SELECT to_url, 1 FROM lf UNION ALL SELECT url, 5 FROM pages)""",
        "fr AS (SELECT url, CAST(min(priority) AS BIGINT) AS priority FROM cand WHERE url NOT IN (SELECT url FROM pages) GROUP BY 1)",
    ]


def shard_rows() -> list[str]:
    return [
        f"sp AS (SELECT {shard('sha256(url)')} AS shard, count(*) AS pages, sum(length({page_text('html', CRAWL_DROP)})) AS chars FROM pages GROUP BY 1)",
        *links("pages", boilerplate=True),
        f"sl AS (SELECT {shard('sha256(from_url)')} AS shard, count(*) AS links FROM edge GROUP BY 1)",
        """ss AS (SELECT CAST(r.range AS BIGINT) AS shard, coalesce(pages, 0) AS pages, coalesce(links, 0) AS links,
         CAST(coalesce(chars, 0) AS BIGINT) AS chars, coalesce(chars, 0) / 1048576e0 AS size_mb
         FROM range(16) r LEFT JOIN sp ON sp.shard = r.range LEFT JOIN sl ON sl.shard = r.range)""",
    ]


SUMMARY = f"""SELECT count(*) AS pages_crawled, count(DISTINCT {netloc('url')}) AS domains_count,
  (epoch_us(max(crawled_at)) - epoch_us(min(crawled_at))) / 1e6 AS uptime, (SELECT count(*) FROM fr) AS queue_size FROM cl"""

def latency(w: str) -> str:
    """The fold over the whole history of each row."""
    return f"""lat AS (SELECT event_id, user_id, list_reduce(list_prepend(0e0, vs), lambda acc, x: x * {w}e0 + acc * (1e0 - {w}e0)) AS y
  FROM (SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vs FROM events))"""

SITEMAPS = f"""sm AS (SELECT {netloc('url')} AS host, CAST(page_id // 1000 AS BIGINT) AS part, '<urlset>' || string_agg('<url><loc> ' || url || ' </loc></url>', '' ORDER BY page_id)
  || '<url><loc>ftp://x/</loc></url></urlset>' AS xml FROM pages GROUP BY host, page_id // 1000)"""


def _excerpts() -> str:
    fields = [*page_fields(), QUERIES, *bm25("pf", "page_id", tokens("title"))]
    words = f"list_filter(regexp_split_to_array(title, {q(T.GAP)}), lambda w: w <> '')"
    hit = f"list_intersect(list_distinct({tokens('w')}), terms)"
    return with_(
        *fields,
        f"tops AS ({top('m', C.TOP_K, 'query_id, doc_id')})",
        "qa AS (SELECT query_id, list(term) AS terms FROM qt GROUP BY 1)",
        f"""tw AS (SELECT query_id, doc_id, rank, url, [{{'f': {hit}, 's': CASE WHEN len({hit}) > 0 THEN '<b>' || w || '</b>' ELSE w END}} FOR w IN {words}] AS ws
          FROM tops JOIN pf ON pf.page_id = doc_id JOIN qa USING (query_id))""",
        """win AS (SELECT *, unnest(range(0, greatest(len(ws) - 16, 0) + 1)) AS s FROM tw)""",
        """sco AS (SELECT *, len(list_distinct(flatten([x.f FOR x IN ws[s + 1:s + 16]]))) AS n FROM win)""",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, s) AS b FROM sco) WHERE b = 1)",
    ) + """SELECT query_id, doc_id, rank, url, (CASE WHEN s > 0 THEN '...' ELSE '' END)
       || array_to_string([x.s FOR x IN ws[s + 1:s + 16]], ' ') || (CASE WHEN s + 16 < len(ws) THEN '...' ELSE '' END) AS excerpt FROM best"""


def _composite() -> str:
    content = "title || ' ' || content"
    joined = f"list_concat({tokens('title')}, {tokens('content')})"
    return with_(
        f"en AS ({ENRICHED})", *safety("en"), *cleaned(), *links("clean", "clean_html", "NOT unsafe"),
        f"pf AS (SELECT *, {title('clean_html')} AS title, {page_text('clean_html', CRAWL_DROP)} AS content FROM clean)",
        QUERIES, *bm25("pf", "page_id", joined),
        f"tops AS ({top('m', C.TOP_K, 'query_id, doc_id')})",
        "hx AS (SELECT query_id, doc_id, rank AS input_rank, content AS corpus, url, score AS safety, page_id FROM tops JOIN pf ON page_id = doc_id)",
        *tfidf("hx"),
        "sh AS (SELECT to_url, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM edge) AS share FROM edge GROUP BY 1)",
        """age AS (SELECT *, floor((epoch_us(TIMESTAMP '2025-01-01') - epoch_us(TIMESTAMP '2024-01-01 00:00:00' + (page_id * 37 + (page_id % 3) * 1000) * INTERVAL '1' HOUR)) / 86400000000e0) AS days FROM hx)""",
        f"""fin AS (SELECT query_id, doc_id, input_rank, similarity, {half_up("0.5e0 * similarity + 0.3e0 * coalesce(share, 0e0) + 0.1e0 * greatest(0.5e0, 1e0 - days / 365e0) + 0.1e0 * safety")} AS score
          FROM age JOIN sim USING (query_id, doc_id) LEFT JOIN sh ON sh.to_url = url)""",
    ) + f"""SELECT query_id, doc_id, {half_up('similarity')} AS similarity, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, input_rank) AS rank FROM fin"""


def _merge_scores() -> list[str]:
    """Versions of the enriched crawl log with their scores, keyed by url and seq."""
    log = C.CRAWL_LOG.format(pages="en")
    return [
        f"en AS ({ENRICHED})", f"lg AS ({log})",
        "ver AS (SELECT page_id * 10 + seq AS vid, page_id, url, seq, crawled_at, CASE WHEN seq > 0 THEN replace(html, 'atob(', 'btoa(') ELSE html END AS html FROM lg)",
        *safety("ver", "vid"),
        "vs AS (SELECT v.*, s.score, s.unsafe FROM ver v JOIN saf s USING (vid))",
    ]


def hard() -> dict[str, str]:
    """Expected rows of the pages with constructs that a plain scan gets wrong, written out by hand."""
    page = f"hp AS ({C.HARD.format(pages='pages')})"
    site = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
    tracker = """'<script data-a=">" src="http://cdn.doubleclick.net/t.js"></script>'"""
    row = "SELECT page_id, CAST({n} AS BIGINT) AS place, '{tag}' AS tag, {src} AS src, {href} AS href FROM pages WHERE {where}"
    rows = [
        row.format(n=0, tag="script", src="NULL", href="NULL", where="true"),
        row.format(n=1, tag="a", src="NULL", href="'/real' || page_id", where="true"),
        row.format(n=2, tag="a", src="NULL", href="'/nav'", where="true"),
        row.format(n=3, tag="script", src="'http://cdn.doubleclick.net/t.js'", href="NULL", where="page_id % 3 = 0"),
        row.format(n=3, tag="script", src="NULL", href="NULL", where="page_id % 3 = 1"),
    ]
    return {
        "elements_hard": " UNION ALL ".join(rows),
        "title_hard": """SELECT page_id, 'T' || page_id || ' \u00a9 1 AA' AS title, 'T' || page_id || ' \u00a9 1 AA r k' || page_id || ' \u00a9right' AS content FROM pages""",
        "links_hard": f"SELECT url AS from_url, {site} || '/real' || page_id AS to_url FROM pages",
        "safety_hard": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 0.76e0 WHEN 1 THEN 0.3e0 ELSE 1e0 END AS score,
            CASE page_id % 3 WHEN 0 THEN 'insecure_script' WHEN 1 THEN 'malicious_script' ELSE '' END AS threats FROM pages""",
        "sanitize_hard": with_(page) + f"""SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN replace(html, {tracker}, '')
            WHEN 1 THEN replace(html, '</title></head>', '</title>' || {q(K.PROTECTION_SNIPPET)} || '</head>') ELSE html END) AS clean_md5 FROM hp""",
    }


@lru_cache(maxsize=1)
def _statements() -> dict[str, str]:
    en = f"en AS ({ENRICHED})"
    cl = f"cl AS ({CRAWL_LOG})"
    seen = f"""ad AS (SELECT page_id, url, CAST(0 AS BIGINT) AS place, url AS address FROM en UNION ALL
      SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos), coalesce(src, href) FROM els WHERE coalesce(src, href, '') <> '')"""
    a = "address"
    flags = f"""SELECT page_id, place, address, {matches(netloc(a), "(?:" + alternation((*K.TRUSTED_DOMAINS, "hub3.example.org")) + ")$")} AS trusted,
      {is_tracker(a)} AS tracker, {is_ad(a)} AS ad, {matches(a, alternation(K.SIGN_IN_ADDRESSES))} AS sign_in, {is_web(a)} AS web,
      starts_with(address, 'http:') AS plain_http, starts_with(address, 'http') AS starts_http FROM ad"""
    media = f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id, type ORDER BY late, pos) AS BIGINT) AS position, type, media_url, alt, width, height, poster, embed FROM (
      SELECT page_id, pos, 0 AS late, 'image' AS type, {resolve('url', 'src')} AS media_url, coalesce(alt, '') AS alt, width, height, NULL AS poster, false AS embed
        FROM els WHERE tag = 'img' AND src IS NOT NULL AND NOT {BAD}
      UNION ALL SELECT page_id, pos, 0, 'video', {resolve('url', 'src')}, NULL, NULL, NULL, CASE WHEN tag = 'video' THEN poster END, false
        FROM els WHERE tag IN ('video', 'source') AND src <> ''
      UNION ALL SELECT page_id, pos, 1, 'video', src, NULL, NULL, NULL, NULL, true
        FROM els WHERE tag = 'iframe' AND {matches('src', alternation(K.VIDEO_HOSTS))} AND NOT {BAD})"""
    shard_any = f"""sa AS (SELECT query_id, doc_id, score, {shard("sha256(CAST(doc_id AS VARCHAR))")} AS shard FROM m)"""
    shard_top = top("sa", C.TOP_K, "query_id, doc_id, score, shard", "query_id, shard")
    stored_fields = [en, *safety("en"), *cleaned(), f"pf AS (SELECT *, {title('clean_html')} AS title, {page_text('clean_html', CRAWL_DROP)} AS content FROM clean)"]
    word_count = f"len(list_filter(regexp_split_to_array(content, {q(T.GAP)}), lambda w: w <> ''))"
    fold = f"translate(lower(text), {q(T.ACCENTED)}, {q(T.UNACCENTED)})"
    folded_query = f"translate(lower(query), {q(T.ACCENTED)}, {q(T.UNACCENTED)})"
    vocabulary = f"voc AS (SELECT DISTINCT unnest({tokens('text')}) AS term FROM documents)"
    page_vocabulary = "voc AS (SELECT DISTINCT term FROM occ)"
    return {
        "page_keys": f"""SELECT page_id, sha256(url) AS url_hash, sha256(html) AS html_hash, md5(url || '_' || length(html)) AS analysis_key,
            {shard('sha256(url)')} AS shard,
            CAST(list_reduce(list_prepend(0, [('0x' || c)::INT FOR c IN string_split(sha256(url), '')]), lambda acc, d: (acc * 16 + d) % 10) AS BIGINT) AS shard_of_10,
            CAST(('0x' || left(sha256(url), 8))::BIGINT % 16 AS BIGINT) AS head_shard FROM pages""",
        "fetched_pages": "SELECT page_id, url, CAST(200 AS BIGINT) AS status FROM pages WHERE NOT contains(url, '?')",
        "sitemap_urls": with_(SITEMAPS) + f"""SELECT host, part, loc FROM (SELECT host, part, {decode('trim(u)')} AS loc FROM (SELECT host, part, unnest(regexp_extract_all(xml, {q(SRC_LOC)}, 1)) AS u FROM sm)) WHERE starts_with(loc, 'http')""",
        "sitemap_candidates": f"""SELECT DISTINCT {scheme('url')} || '://' || {netloc('url')} AS site, {scheme('url')} || '://' || {netloc('url')} || '/sitemap.xml' AS first_url,
            {scheme('url')} || '://' || {netloc('url')} || '/sitemap_index.xml' AS fallback_url FROM pages""",
        "sitemap_choice": f"""WITH sm AS (SELECT {netloc('url')} AS host, '<urlset><url><loc>' || min(url) || '</loc></url></urlset>' AS xml FROM pages GROUP BY 1) SELECT 'http://' || host AS site, 'http://' || host || CASE WHEN length(host) % 2 = 0 THEN '/sitemap.xml' ELSE '/sitemap_index.xml' END AS sitemap_url,
            length(xml) AS n_chars FROM sm WHERE length(host) % 2 = 0 OR length(host) % 3 = 0""",
        "store_round_trip": f"SELECT page_id, sha256(url) AS url_hash, {shard('sha256(url)')} AS shard, sha256(html) AS html_hash FROM pages",
        "store_shard_read": f"SELECT page_id, url FROM pages WHERE {shard('sha256(url)')} = 3 AND length(html) >= 1000",
        "netloc": f"SELECT page_id, {netloc('url')} AS netloc, {scheme('url')} AS scheme FROM pages",
        "url_flags": with_(en, elements("en"), seen) + flags,
        "blocked_urls": f"""SELECT page_id, url, {matches('url', alternation(K.SIGN_IN_ADDRESSES))} AS blocked FROM
            (SELECT page_id, CASE WHEN {scheme('url')} = 'https' THEN 'https://accounts.google.com/?continue=' || url ELSE url END AS url FROM pages)""",
        "resolve_links": with_(en, elements("en"), seen) + f"SELECT page_id, place, {resolve('url', 'address')} AS resolved FROM ad WHERE place > 0",
        "elements": with_(en, elements("en")) + "SELECT page_id, pos, tag, src, href, css, alt, width, height, poster, http_equiv, script_text FROM els",
        "page_text": f"""SELECT page_id, title, content, index_text, CAST({word_count} AS BIGINT) AS word_count FROM (
            SELECT page_id, {title('html')} AS title, {page_text('html', CRAWL_DROP)} AS content, {page_text('html', INDEX_DROP)} AS index_text FROM pages)""",
        "page_media": with_(en, elements("en")) + media,
        "page_media_json": with_(en, elements("en"), f"md AS ({media})") + """SELECT page_id, CAST(count(*) FILTER (type = 'image') AS BIGINT) AS n_images,
            CAST(count(*) FILTER (type = 'video') AS BIGINT) AS n_videos,
            '[' || coalesce(string_agg('{"url":"' || media_url || '","alt":"' || alt || '","width":' || coalesce('"' || width || '"', 'null') || ',"height":' || coalesce('"' || height || '"', 'null') || ',"type":"image"}', ',' ORDER BY position) FILTER (type = 'image'), '') || ']' AS images_json
            FROM pages LEFT JOIN md USING (page_id) GROUP BY 1""",
        "safety_score": with_(en, *safety("en")) + f"""SELECT page_id, {netloc('url')} AS domain, {half_up('score')} AS score,
            CAST(CASE WHEN ok THEN 1 ELSE m + i + r::INT END AS BIGINT) AS n_threats, CAST(t AS BIGINT) AS n_trackers, CAST(a AS BIGINT) AS n_ads,
            CAST(m AS BIGINT) AS n_scripts, unsafe AS sandbox_required, unsafe AS has_snippet FROM saf""",
        "safety_trusted": with_(en, *safety("en", trusted=(*K.TRUSTED_DOMAINS, "example.net"), hsts=scheme("p.url") + " = 'https'")) + f"""SELECT page_id, {half_up('score')} AS score,
            CASE WHEN ok THEN 'trusted_domain' ELSE array_to_string(list_concat(list_concat([ 'malicious_script' FOR x IN range(m)], ['insecure_script' FOR x IN range(i)]),
              CASE WHEN r THEN ['meta_refresh'] ELSE [] END), ',') END AS threats, unsafe AS sandbox_required FROM saf""",
        "safety_findings": with_(en, *safety("en")) + f"""SELECT page_id, kind, row_number() OVER (PARTITION BY page_id, kind ORDER BY grp, pos) AS position, value FROM (
            SELECT page_id, 'threats' AS kind, 1 AS grp, pos, 'malicious_script' AS value FROM els WHERE tag = 'script' AND {matches('script_text', MALICIOUS)}
            UNION ALL SELECT page_id, 'threats', 2, pos, 'insecure_script' FROM els WHERE tag = 'script' AND starts_with(src, 'http:')
            UNION ALL SELECT page_id, 'threats', 3, 0, 'meta_refresh' FROM saf WHERE r
            UNION ALL SELECT page_id, 'trackers', grp, pos, {netloc('u')} FROM addr WHERE {is_tracker('u')}
            UNION ALL SELECT page_id, 'ads', grp, pos, u FROM addr WHERE {is_ad('u')}
            UNION ALL SELECT page_id, 'scripts', 1, pos, left(raw, 100) FROM els WHERE tag = 'script' AND {matches('script_text', MALICIOUS)})""",
        "sanitize_pages": with_(en, *safety("en"), *cleaned()) + "SELECT page_id, sha256(clean_html) AS clean_hash, length(clean_html) AS n_chars FROM clean",
        "keywords_top": with_(*keyword_rows("documents", "doc_id", "text")) + "SELECT doc_id, rank, word, n FROM kw",
        "page_keywords": with_(*page_fields(), *keyword_rows("pf", "page_id", "content")) + "SELECT sha256(url) AS url_hash, coalesce(ks, '') AS keywords FROM pages LEFT JOIN (SELECT page_id, string_agg(word, ' ' ORDER BY rank) AS ks FROM kw GROUP BY 1) USING (page_id)",
        "stored_pages": with_(*stored_fields, f"im AS (SELECT page_id, count(*) AS k FROM els WHERE tag = 'img' AND src IS NOT NULL AND NOT {BAD} GROUP BY 1)") + f"""SELECT sha256(url) AS url_hash, url, title, md5(content) AS content_md5, sha256(html) AS html_hash,
            CAST(200 AS BIGINT) AS http_status, '' AS content_type, CAST({word_count} AS BIGINT) AS word_count, {half_up('score')} AS security_score, unsafe AS is_dangerous,
            {netloc('url')} AS domain, CAST(0 AS BIGINT) AS popularity, CAST(coalesce(k, 0) AS BIGINT) AS n_images FROM pf LEFT JOIN im USING (page_id)""",
        "direct_index": with_(en, *safety("en")) + f"""SELECT sha256(url) AS url_hash, {title('html')} AS title, {half_up('score')} AS security_score, unsafe AS is_dangerous,
            md5({page_text('html', INDEX_DROP)}) AS text_md5, CAST(5 AS BIGINT) AS priority FROM saf""",
        "stem_vocabulary": with_(vocabulary) + porter("voc"),
        "link_edges": with_(*safe_links()) + "SELECT DISTINCT from_url, to_url FROM edge",
        "link_edges_all": with_(*links("pages", boilerplate=True)) + "SELECT from_url, to_url FROM edge",
        "link_share": with_(*safe_links(), "de AS (SELECT DISTINCT from_url, to_url FROM edge)") + f"SELECT to_url, count(*) AS n_in, {half_up('count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM de)')} AS share FROM de GROUP BY 1",
        "edges_ignore": with_(*links("pages", boilerplate=True, name="le")) + f"SELECT from_url, to_url FROM le WHERE {scheme('from_url')} <> 'https'",
        "frontier": with_(*candidates()) + "SELECT url, priority FROM fr",
        "frontier_next": with_(*candidates()) + f"SELECT url, priority FROM fr ORDER BY priority, url LIMIT {C.FRONTIER_K}",
        "fetch_timetable": with_(*candidates()) + f"""SELECT *, (turn - 1) * 0.5e0 AS start_s FROM (SELECT {netloc('url')} AS host, url, priority,
            row_number() OVER (PARTITION BY {netloc('url')} ORDER BY priority, url) AS turn FROM fr)""",
        "discovery_sites": f"SELECT DISTINCT {netloc('url')} AS host, 'http://' || {netloc('url')} AS site_url FROM pages",
        "upsert_replace": with_(cl) + """SELECT sha256(url) AS url_hash, page_id, url, CAST(seq AS BIGINT) AS seq, epoch_us(crawled_at) AS crawled_us FROM cl
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, seq DESC) = 1""",
        "upsert_reset": """SELECT page_id, url, CAST(CASE WHEN page_id % 3 = 0 THEN 7 ELSE 0 END AS BIGINT) AS popularity, CAST(page_id % 3 AS BIGINT) AS seq FROM pages""",
        "upsert_merge": with_(*_merge_scores(), f"""nw AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)""", "od AS (SELECT * FROM vs WHERE seq = 0)")
        + f"""SELECT sha256(nw.url) AS url_hash, {title('nw.html', 'nw.url')} AS title, {half_up('nw.score')} AS security_score, od.unsafe AS is_dangerous,
            {netloc('od.url')} AS domain, epoch_us(nw.crawled_at) AS crawled_us FROM nw JOIN od USING (page_id)""",
        "insert_valid": f"SELECT page_id, sha256(url) AS url_hash, {shard('sha256(url)')} AS shard FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#')",
        **hard(),
        "analysis_once": with_(cl) + "SELECT DISTINCT md5(url || '_' || length(html)) AS analysis_key, url, epoch_us(crawled_at) AS crawled_us FROM cl",
        "postings": with_(*page_fields(), *keyword_rows("pf", "page_id", "content"),
            "pk AS (SELECT pf.page_id, title, content, coalesce(ks, '') AS keywords FROM pf LEFT JOIN (SELECT page_id, string_agg(word, ' ' ORDER BY rank) AS ks FROM kw GROUP BY 1) USING (page_id))",
            field_postings({"title": "title", "keywords": "keywords", "content": "content"}, "pk")) + f"SELECT page_id, field, term, count(*) AS tf, {POSITIONS} FROM occ GROUP BY ALL",
        "postings_stemmed": with_(*page_fields(), field_postings({"title": "title", "content": "content"}), page_vocabulary, f"sv AS ({porter('voc')})")
        + f"SELECT page_id, field, stem AS term, count(*) AS tf, {POSITIONS} FROM occ JOIN sv USING (term) GROUP BY ALL",
        "term_statistics": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY 1",
        "document_lengths": f"SELECT doc_id, len({tokens('text')}) AS dl FROM documents",
        "search_bm25": with_(*DOCS_ALL, MATCH_ALL) + top("m2", C.TOP_K, "query_id, doc_id, score"),
        "search_any": with_(*DOCS_ANY) + top("m", C.TOP_K, "query_id, doc_id, n_matched, score"),
        "search_all_matches": with_(*DOCS_ALL, MATCH_ALL) + "SELECT query_id, doc_id, score FROM m2",
        "search_phrase": with_(PHRASES, *DOCS_ANY[1:], MATCH_ALL,
            "ph AS (SELECT query_id, ' ' || array_to_string(" + tokens("query") + ", ' ') || ' ' AS p FROM qs)",
            "dx AS (SELECT doc_id, ' ' || array_to_string(toks, ' ') || ' ' AS d FROM dt)")
        + "SELECT query_id, doc_id, score FROM m2 JOIN ph USING (query_id) JOIN dx USING (doc_id) WHERE contains(d, p)",
        "search_boolean": with_(QUERIES, *bm25("documents", "doc_id", tokens("text"), name="unused"),
            "ol AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(term), term) AS up, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term DESC) AS down FROM qt)",
            "wanted AS (SELECT query_id, term FROM ol WHERE up <= 2)", *weights("wanted", "mw"),
            "nt AS (SELECT query_id, count(*) AS nt FROM wanted GROUP BY 1)",
            "banned AS (SELECT DISTINCT query_id, doc_id FROM ol JOIN tf USING (term) WHERE down <= 2)")
        + "SELECT query_id, doc_id, score FROM mw JOIN nt USING (query_id) WHERE n_matched = nt AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM banned)",
        "search_shard_topk": with_(*DOCS_ANY, shard_any) + shard_top,
        "search_merged": with_(*DOCS_ANY, shard_any, f"stp AS ({shard_top})") + top("(SELECT query_id, doc_id, score FROM stp)", C.TOP_K, "query_id, doc_id, score"),
        "search_page": with_(*DOCS_ANY) + top("m", 2 * C.TOP_K, "query_id, doc_id, score", low=C.TOP_K),
        "search_envelope": with_("qs AS (SELECT 0 AS query_id, 'the that' AS query)", *bm25("documents", "doc_id", tokens("text")), MATCH_ALL)
        + f"SELECT 'the that' AS query, 'all' AS category, CAST(1 AS BIGINT) AS page, doc_id, score, rank FROM ({top('m2', C.TOP_K, 'query_id, doc_id, score')})",
        "segment_search": with_(FREQUENT, LEFT_DOCS, *bm25("left_docs", "doc_id", tokens("text")), MATCH_ALL) + top("m2", C.TOP_K, "query_id, doc_id, score"),
        "segment_topk": with_(QUERIES, LEFT_DOCS, *bm25("left_docs", "doc_id", tokens("text"))) + top("m", C.TOP_K, "query_id, doc_id, n_matched, score"),
        "search_stored_index": with_(*DOCS_ALL, MATCH_ALL) + top("m2", C.TOP_K, "query_id, doc_id, score"),
        "search_folded": with_(f"qs AS (SELECT item_id AS query_id, {folded_query.replace('query', 'text')} AS query FROM benchmark)",
            *bm25("documents", "doc_id", f"regexp_extract_all({fold}, {q(T.INDEX_TOKEN)})"), MATCH_ALL) + "SELECT query_id, doc_id, score FROM m2",
        "snippets": _excerpts(),
        "suggest_prefix": with_(*page_fields(), f"qs AS (SELECT DISTINCT unnest({tokens('text')}) AS query_id FROM benchmark)",
            f"dt AS (SELECT page_id AS doc_id, {tokens('title')} AS toks FROM pf)", "dl AS (SELECT doc_id, len(toks) AS dl FROM dt)", "st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl)",
            "tf AS (SELECT query_id AS term, doc_id, count(*) AS tf FROM qs JOIN (SELECT doc_id, unnest(toks) AS w FROM dt) ON starts_with(w, query_id) GROUP BY ALL)",
            "df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)", "qt AS (SELECT query_id, query_id AS term FROM qs WHERE length(query_id) >= 2)", *weights("qt", "m"))
        + top("m", K.DEFAULT.suggest_limit, "query_id, doc_id, score"),
        "tfidf_cosine": with_(*DOCS_TOP, "hx AS (SELECT query_id, doc_id, text AS corpus FROM tops JOIN documents USING (doc_id))", *tfidf("hx")) + f"SELECT query_id, doc_id, {half_up('similarity')} AS similarity FROM sim",
        "tfidf_titles": with_(*DOCS_TOP, "hx AS (SELECT query_id, doc_id, text AS corpus FROM tops JOIN documents USING (doc_id))", *tfidf("hx")) + f"SELECT query_id, doc_id, {half_up('similarity')} AS similarity FROM sim",
        "word_overlap": with_(*DOCS_TOP) + f"""SELECT query_id, doc_id, {half_up("CAST(count(*) FILTER (contains(t, w)) AS DOUBLE) / greatest(count(*), 1)")} AS overlap FROM (
            SELECT query_id, doc_id, ' ' || lower(text) AS t, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), {q(T.GAP)}), lambda w: w <> ''))) AS w
            FROM tops JOIN (SELECT doc_id, text FROM documents) USING (doc_id) JOIN qs USING (query_id)) GROUP BY 1, 2""",
        "freshness": with_(cl) + f"""SELECT page_id, CAST(seq AS BIGINT) AS seq, {half_up("greatest(0.5e0, 1e0 - floor((epoch_us(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(crawled_at)) / 86400000000e0) / 365e0)")} AS freshness FROM cl""",
        "rank_composite": _composite(),
        "neutral_score": "SELECT page_id, 0.5e0 AS prediction FROM pages",
        "shard_stats": with_(*shard_rows()) + f"SELECT shard, pages, links, chars, {half_up('size_mb')} AS size_mb FROM ss",
        "store_totals": with_(*shard_rows()) + f"SELECT CAST(sum(pages) AS BIGINT) AS total_pages, CAST(sum(links) AS BIGINT) AS total_links, {half_up('sum(size_mb)')} AS total_size_mb FROM ss",
        "shard_report": with_(*shard_rows()) + f"SELECT shard, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(links) AS BIGINT) AS links, {half_up('sum(size_mb)')} AS size_mb FROM ss GROUP BY ROLLUP (shard)",
        "shard_imbalance": with_(*shard_rows(), "av AS (SELECT CAST(sum(pages) AS DOUBLE) / 16 AS a FROM ss)") + f"SELECT shard, pages, {half_up('a')} AS avg_pages, (pages > a * 1.5e0 OR pages < a * 0.5e0) AS unbalanced FROM ss CROSS JOIN av",
        "latency_slow_weight": with_(latency("0.3")) + f"SELECT event_id, user_id, {half_up('y + 1e-9')} AS smoothed FROM lat",
        "latency_smoothed": with_(latency("0.9")) + f"SELECT event_id, user_id, {half_up('y + 1e-9')} AS smoothed FROM lat",
        "slow_shards": with_(latency("0.9")) + "SELECT user_id, count(*) AS n_slow FROM lat WHERE y > 0.1e0 GROUP BY 1",
        "crawl_summary": with_(*candidates(), cl) + SUMMARY,
        "stats_report": with_(*candidates(), cl, *shard_rows(), f"su AS ({SUMMARY})",
            f"tt AS (SELECT CAST(sum(pages) AS BIGINT) AS total_pages, CAST(sum(links) AS BIGINT) AS total_links, {half_up('sum(size_mb)')} AS total_size_mb FROM ss)") + "SELECT * FROM tt CROSS JOIN su",
        "cache_retention": with_(cl) + "SELECT page_id, CAST(seq AS BIGINT) AS seq, epoch_us(crawled_at) AS cached_us FROM cl WHERE crawled_at >= TIMESTAMP '2024-02-20 05:00:00' - INTERVAL 30 DAYS",
        "operation_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "pages_by_domain": with_(cl) + f"""SELECT domain, page_id, seq, rank FROM (SELECT {netloc('url')} AS domain, page_id, CAST(seq AS BIGINT) AS seq,
            row_number() OVER (PARTITION BY {netloc('url')} ORDER BY crawled_at DESC, page_id, seq) AS rank FROM cl) WHERE rank <= {C.TOP_K}""",
        "popular_pages": with_(*candidates()) + f"SELECT url, count(*) AS popularity FROM cand GROUP BY 1 ORDER BY popularity DESC, url LIMIT {C.TOP_K}",
        "stream_ingest": with_(*page_fields()) + f"""SELECT page_id, sha256(url) AS url_hash, title, CAST({word_count} AS BIGINT) AS word_count, {half_up('score')} AS security_score, unsafe AS is_dangerous FROM pf""",
        "stream_merge": with_(*page_fields()) + f"""SELECT page_id, sha256(url) AS url_hash, title, CAST({word_count} AS BIGINT) AS word_count, {half_up('score')} AS security_score, unsafe AS is_dangerous FROM pf""",
        "stream_summary": f"SELECT count(*) AS pages_crawled, count(DISTINCT {netloc('url')}) AS domains_count FROM pages",
        "stream_dedup": "SELECT page_id, md5(url || '_' || length(html)) AS analysis_key FROM pages",
        "stream_frontier": with_(*safe_links()) + "SELECT DISTINCT to_url AS url, CAST(0 AS BIGINT) AS priority FROM edge WHERE to_url NOT IN (SELECT url FROM pages)",
    }



def statements() -> dict[str, str]:
    return dict(_statements())
