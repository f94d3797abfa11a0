"""Address functions and predicates, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import let, literal_alternation

NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# RFC 3986 appendix B: scheme, authority, path, query, fragment
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def netloc(url: Column) -> Column:
    """Host with user info and port, case kept; empty when there is none."""
    return F.regexp_extract(url, NETLOC, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def is_trusted(host: Column, cfg: Settings = DEFAULT) -> Column:
    """Host ends with a trusted name (any suffix; whole labels when strict)."""
    lead = r"(?:^|\.)" if cfg.strict else ""
    return host.rlike(f"{lead}(?:{literal_alternation(cfg.trusted_domains)})$")


def is_tracker(host: Column, cfg: Settings = DEFAULT) -> Column:
    """Host contains a tracker name."""
    return host.rlike(literal_alternation(cfg.tracker_domains))


def is_ad(text: Column, cfg: Settings = DEFAULT) -> Column:
    """Lower-cased text contains an advert word, so "download" counts too
    (whole words only when strict)."""
    words = literal_alternation(cfg.ad_words)
    return F.lower(text).rlike(rf"\b(?:{words})\b" if cfg.strict else words)


def is_sign_in(url: Column, cfg: Settings = DEFAULT) -> Column:
    """Address on the deny list of sign-in pages."""
    return url.rlike(literal_alternation(cfg.sign_in_addresses))


def is_web(url: Column) -> Column:
    """http or https address with a host."""
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def is_plain_http(url: Column) -> Column:
    return url.startswith("http:")


def starts_with_http(url: Column) -> Column:
    return url.startswith("http")


def _split(url: Column) -> Column:
    names = ("scheme", "netloc", "path", "query", "fragment")
    return F.struct(
        *[
            (F.lower(F.regexp_extract(url, PARTS, i)) if n == "scheme" else F.regexp_extract(url, PARTS, i)).alias(n)
            for i, n in enumerate(names, start=1)
        ]
    )


def _unsplit(scheme_: Column, netloc_: Column, path: Column, query: Column, fragment: Column) -> Column:
    slash = F.when((netloc_ != "") & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(
        scheme_, F.lit("://"), netloc_, slash, path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _remove_dots(segments: Column) -> Column:
    """Resolve "." and ".." segments and join the rest with slashes."""
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(closed, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merge_path(base_path: Column, path: Column) -> Column:
    own = F.split(path, "/", -1)

    def relative(both: Column) -> Column:
        # empty segments vanish, except the first and the last one
        return F.filter(both, lambda s, i: (i == 0) | (i == F.size(both) - 1) | (s != ""))

    base_dir = F.split(F.regexp_replace(base_path, "[^/]+$", ""), "/", -1)
    # without its last name a path ends with "/": the split then closes on ''
    head = F.when(
        base_path.rlike("[^/]$"), F.slice(base_dir, F.lit(1), F.size(base_dir) - 1)
    ).otherwise(base_dir)
    segments = F.when(path.startswith("/"), own).otherwise(let(F.concat(head, own), relative))
    # most addresses have neither dots nor doubled slashes
    plain = path.startswith("/") & ~path.rlike(r"(?:^|/)\.{1,2}(?:/|$)")
    return F.when(plain, path).otherwise(let(segments, _remove_dots))


def _resolve(base: Column, parts: Column, href: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")

    def joined(b: Column, h: Column) -> Column:
        foreign = (h["scheme"] != "") & (h["scheme"] != b["scheme"])
        return (
            F.when(href == "", base)
            .when(foreign, href)
            .when(h["netloc"] != "", _unsplit(b["scheme"], h["netloc"], h["path"], h["query"], h["fragment"]))
            .when(
                h["path"] == "",
                _unsplit(
                    b["scheme"], b["netloc"], b["path"],
                    F.when(h["query"] != "", h["query"]).otherwise(b["query"]),
                    h["fragment"],
                ),
            )
            .otherwise(
                _unsplit(b["scheme"], b["netloc"], _merge_path(b["path"], h["path"]), h["query"], h["fragment"])
            )
        )

    return let(_split(clean), lambda h: joined(parts, h))


def resolve(base: Column, href: Column) -> Column:
    """Address of a link ``href`` found on the page ``base``."""
    return let(_split(base), lambda parts: _resolve(base, parts, href))


def resolve_all(base: Column, hrefs: Column) -> Column:
    """Addresses of an array of links; the page address is taken apart once."""
    return let(_split(base), lambda parts: F.transform(hrefs, lambda h: _resolve(base, parts, h)))
