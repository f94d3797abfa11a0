"""Main text of pages by consensus on the container paths of their host.

Every page is read by one scan of its tags. Its containers are scored by the text outside links of
the blocks below them (whole for the nearest container, half for each one above, whole again for
article and main), and each generalised path (tags with their classes, digits left out) gives its
host a vote, the score as a share of the page's best. Spark adds the votes of a host and counts the
pages that hold the path; a page takes, of its own paths, the one with the best vote per page that
holds it (one page without a vote is added, so that a path of one page proves little). Equal ones:
the deeper path. So a page whose own layout misleads the score follows its host, and each template
of a host has paths of its own. Where the taken path only inherits (the page's best path lies
below it, and both its vote on the page and the host's per page are under three quarters; half comes
from below), the best path is taken. A path is known by a 64-bit hash of all its elements, at any depth,
and scores reach every container above a block, in one pass from the last element to the first.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role and class words wherever they stand. A class or id counts by its whole name, and
never for html, body, main, article or an element that holds more than half of the page's text (what tags
and roles leave out not counted), but for one beside the page's article or main. Block elements end a block, inline ones
and line breaks do not (a line break is white space). White space is any Unicode white space.

Two narrow scans of the pages, linear in their length: an opener that no ``>`` ends is text, and from the
first of these on a table tells which others are alike. The votes are rows of page (64-bit hash of its source), path and vote; they
are added up by (host, path) with a partial step and meet the sums by a join on (host, path), and
each page's best comes by an aggregation by page. Both joins broadcast if the smaller side is small
(checked), else shuffle, and adaptive execution splits a large host. A null html or url is empty; an unclosed element ends with its
parent; rows that repeat vote and return as often as they come. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.text import slices
from pagelake.sources.store import broadcast_if_small, materialise

#: Key of the empty path.
ROOT = 0
#: Votes (in millionths) under which a path above the page's best one only inherits its score.
INHERITED = 750_000

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*+>",
    re.S | re.I,
)
_OTHER = re.compile(r"<[!?/][^>]*+>")
_LETTER = re.compile(r"</?[a-zA-Z]")
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body head p h1 h2 h3 h4 h5 h6 div article main section ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary fieldset nav header footer aside form menu dialog hgroup center".split()
)
_CONTAINER = frozenset("body div article main section td blockquote center".split())
_WHOLE = frozenset(("article", "main"))
_LEFT_OUT = frozenset("head nav header footer aside form menu dialog button object canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer masthead topbar sidebar sidebars widget widgets comment comments commentlist respond reply replies disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended recommendations pagination pager toolbar copyright disclaimer".split()
)
_HEADERS = re.compile(r"(?:site|page|top|main|global)[-_]?header")
#: What a class name of several words may say beside those words: place, order and kind of box.
_BESIDE = frozenset("area bar block bottom box button container global inner item left links list main outer page panel post primary right secondary section site slot top unit wrap wrapper".split())
#: Elements that no class or id leaves out.
_KEPT = frozenset(("html", "body", "main", "article"))
#: An open element that a new one of the same group ends, and where the search for it stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def closed_from(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes and ``>``, and whether attributes that start there meet a ``>`` outside quotes."""
    codes = np.frombuffer(source.encode("latin-1", "replace"), np.uint8)
    places = np.flatnonzero((codes == 62) | (codes == 34) | (codes == 39))
    bare = double = single = False
    flags = bytearray(len(places))
    for i, c in zip(range(len(places) - 1, -1, -1), codes[places][::-1].tobytes()):
        if c == 62:
            bare = True
        elif c == 34:
            bare, double = double, bare
        else:
            bare, single = single, bare
        flags[i] = bare
    return places, np.frombuffer(flags, np.uint8)


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it is an end tag, name ("" for comments and other markup) and attributes.

    Linear in the length of the page: the first opener that no ``>`` ends makes a table of the others.
    """
    at = name_end = 0
    last = source.rfind(">")
    closed = None
    while 0 <= (at := source.find("<", at)) <= last:
        complete = True
        if closed is not None and _LETTER.match(source, at):
            if name_end <= at:
                name_end = _NAME.match(source, at).end()
            i = int(np.searchsorted(closed[0], name_end))
            complete = i < len(closed[0]) and bool(closed[1][i])
        m = _TAG.match(source, at) if complete else _OTHER.match(source, at)
        if m and complete and m[3]:
            yield at, m.end(), m[2] == "/", m[3].lower(), m[4]
        elif closed is None and not (m and m[1]) and _LETTER.match(source, at):
            closed = closed_from(source)
            continue
        elif m:
            yield at, m.end(), False, "", ""
        at = m.end() if m else at + 1
    if at >= 0 and (start := source.find("<!--", at)) >= 0:
        yield start, len(source), False, "", ""


@lru_cache(1 << 16)
def below(above: int, step: str) -> int:
    """Key of the path that adds an element to another."""
    made = hashlib.blake2b(above.to_bytes(8, "little", signed=True) + step.encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(made.digest(), "little", signed=True)


class Page:
    """Elements (parent, tag, key and depth of the path) and blocks (element, text, characters in links) of a page."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.path, self.depth = [0], [""], [ROOT], [0]
        self.blocks: list[tuple[int, str, int]] = []
        #: Elements whose class or id names them as unwanted, in order.
        self.named: list[int] = []
        self._fill(self._read(source or ""))

    def _fill(self, read: list[tuple[int, list[tuple[int, str, bool]]]]) -> None:
        """Blocks from (element, pieces of text) without what lies below unwanted elements."""
        gone = self._gone(read) if self.named else ()
        for element, pieces in read:
            kept = [x for x in pieces if not gone or not gone[x[0]]]
            text = " ".join(entities.unescape("".join([x[1] for x in kept])).split())
            if text:
                self.blocks.append((element, text, sum(len(x[1]) for x in kept if x[2])))

    def _gone(self, read: list[tuple[int, list[tuple[int, str, bool]]]]) -> list[bool]:
        """Elements that are unwanted by name and not the bulk of the page, and all below them.

        The bulk is more than half of the text, where no article or main with text stands beside it.
        """
        held = [0] * len(self.tag)
        for _, pieces in read:
            for e, piece, _ in pieces:
                held[e] += len("".join(piece.split()))
        whole = [t in _WHOLE for t in self.tag]
        above, below = whole.copy(), [False] * len(held)
        for e in range(1, len(held)):  # parents come before their children
            above[e] = above[e] or above[self.parent[e]]
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
            below[self.parent[e]] = below[self.parent[e]] or below[e] or (whole[e] and held[e] > 0)
        gone = [False] * len(held)
        for e in self.named:
            gone[e] = 2 * held[e] <= held[0] or (below[0] and not above[e] and not below[e])
        for e in range(1, len(gone)):
            gone[e] = gone[e] or gone[self.parent[e]]
        return gone

    def _read(self, source: str) -> list[tuple[int, list[tuple[int, str, bool]]]]:
        stack, left_out, blocks_to = [0], [False], [0]
        #: Depths in the stack of each open tag.
        where: dict[str, list[int]] = defaultdict(list)
        words: list[tuple[int, str, bool]] = []
        read: list[tuple[int, list[tuple[int, str, bool]]]] = []
        links = at = 0

        def end_block() -> None:
            if words:
                read.append((stack[-1], words.copy()))
                words.clear()

        def pop_to(depth: int) -> None:
            for e in stack[depth:]:
                where[self.tag[e]].pop()
            del stack[depth:], left_out[depth:], blocks_to[depth:]

        def innermost(names: Iterable[str]) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=0)

        for start, end, ending, name, attributes in tags(source):
            if start > at and not left_out[-1]:
                words.append((stack[-1], source[at:start], links > 0))
            at = end
            if not name:
                continue
            block = name in _BLOCK
            if block:
                end_block()
            if ending:
                if name == "a":
                    links = 0
                depth = innermost((name,))
                # an inline end tag does not close the blocks around it
                if depth and (block or blocks_to[-1] == blocks_to[depth]):
                    pop_to(depth)
                continue
            if name in _VOID:
                if name == "hr":
                    end_block()
                elif name == "br" and not left_out[-1]:
                    words.append((stack[-1], " ", False))
                continue
            if name == "a":
                links = 1
            named = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if "=" in attributes else {}
            out = left_out[-1] or name in _LEFT_OUT or named.get("role", "").lower() in _ROLES
            marked = not out and name not in _KEPT and self._unwanted(named)
            if not block and not marked and not (out and not left_out[-1]):
                continue
            if block:
                if len(stack) > 1 and self.tag[stack[-1]] == "p":
                    pop_to(len(stack) - 1)
                ended, stop = _ENDS.get(name, ((), ()))
                depth = innermost(ended)
                if depth > innermost(stop):
                    pop_to(depth)
            self.parent.append(stack[-1])
            self.tag.append(name)
            if marked:
                self.named.append(len(self.tag) - 1)
            classes = sorted({re.sub(r"\d+", "", c) for c in named.get("class", "").lower().split()} - {""})
            self.path.append(below(self.path[stack[-1]], ".".join([name, *classes])))
            self.depth.append(self.depth[stack[-1]] + 1)
            where[name].append(len(stack))
            stack.append(len(self.tag) - 1)
            left_out.append(out or left_out[-1])
            blocks_to.append(blocks_to[-1] + block)
        if not left_out[-1]:
            cut = re.search(r"<[a-zA-Z/!?]", source[at:])  # a tag that the page's end cuts off
            words.append((stack[-1], source[at : at + cut.start()] if cut else source[at:], False))
        end_block()
        return read

    @staticmethod
    def _unwanted(named: dict[str, str]) -> bool:
        """Whether a whole class or id is an unwanted word, or several with words of place only."""
        for token in f"{named.get('class') or ''} {named.get('id') or ''}".lower().split():
            if _HEADERS.fullmatch(token):
                return True
            parts = set(re.split(r"[^a-z]+", token)) - {""}
            if not _WORDS.isdisjoint(parts) and parts <= _WORDS | _BESIDE:
                return True
        return False

    def scores(self) -> dict[int, float]:
        """Score of each container path."""
        # what lies in an element: text of blocks without a container yet, all text, and the share that counts
        plain, whole, share = ([0.0] * len(self.tag) for _ in range(3))
        for element, text, linked in self.blocks:
            plain[element] += max(len(text) - linked, 0)
        found: dict[int, float] = {}
        for e in range(len(self.tag) - 1, -1, -1):  # parents come before their children
            if e == 0 or self.tag[e] in _CONTAINER:
                share[e] = plain[e] + (whole[e] if self.tag[e] in _WHOLE else share[e] / 2)
                whole[e] += plain[e]
                plain[e] = 0.0
                found[self.path[e]] = found.get(self.path[e], 0.0) + share[e]
            if e:
                for sums in (plain, whole, share):
                    sums[self.parent[e]] += sums[e]
        return {p: s for p, s in found.items() if s > 0}

    def votes(self) -> dict[int, tuple[int, float]]:
        """Depth and share of the best score for each container path that has a block on or below it."""
        own = self.scores()
        top = max(own.values(), default=1.0)
        held = [False] * len(self.path)
        for e, _, _ in self.blocks:
            held[e] = True
        for e in range(len(held) - 1, 0, -1):  # parents come before their children
            held[self.parent[e]] = held[self.parent[e]] or held[e]
        rows = zip(self.path, self.depth, self.tag, held)
        return {p: (n, own.get(p, 0.0) / top) for p, n, t, h in rows if h and (p == ROOT or t in _CONTAINER)}

    def text(self, path: int | None = None, best: int | None = None) -> str:
        """Blocks below the path, or without one below the page's own best path.

        With ``best`` below the path, those below ``best``.
        """
        if path is None:
            own, depth = self.scores(), dict(zip(self.path, self.depth))
            path = max(own, key=lambda p: (own[p], depth[p], p), default=ROOT)
        if best is not None and best != path and best in self.path:
            e = self.path.index(best)
            while e and self.path[e] != path:
                e = self.parent[e]
            path = best if self.path[e] == path else path
        inside = [p == path for p in self.path]
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[self.parent[e]]
        return "\n".join(text for e, text, _ in self.blocks if inside[e])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """host, page, path, n (its depth) and vote (in millionths) of every container path of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            hosts, keys, paths, depths, shares = [], [], [], [], []
            for h, key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = Page(source.as_py()).votes()
                hosts += [h] * len(own)
                keys += [key] * len(own)
                paths += own
                depths += [n for n, _ in own.values()]
                shares += [round(s * 1_000_000) for _, s in own.values()]
            made = [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (keys, paths, depths, shares))]
            yield pa.RecordBatch.from_arrays(made, ["host", "page", "path", "n", "vote"])

    return pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").mapInArrow(run, "host string, page long, path long, n long, vote long")


def chosen_paths(pages: DataFrame) -> DataFrame:
    """host, page, the path that its host agrees on, and the page's best one where the other may only inherit (else null)."""
    cast = materialise(votes(pages), "votes")
    # votes are whole millionths, so that the order of adding cannot matter
    summed = cast.groupBy("host", "path").agg((F.sum("vote") / (F.count("*") + 1)).alias("mean"))
    own = cast.join(broadcast_if_small(materialise(summed, "pathvotes")), ["host", "path"])
    picked = own.groupBy("host", "page").agg(F.max(F.struct("mean", "n", "path", "vote")).alias("a"), F.max(F.struct("vote", "n", "path")).alias("b"))
    inherits = (F.col("a.vote") < INHERITED) & (F.col("a.mean") < INHERITED)
    return picked.select("host", "page", F.col("a.path").alias("path"), F.when(inherits, F.col("b.path")).alias("best"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    chosen = broadcast_if_small(materialise(chosen_paths(pages), "chosenpaths"))
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    joined = keyed.join(chosen, ["host", "page"], "left").select("page_id", "url", "html", "path", "best")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            taken = zip(batch.column("html"), batch.column("path").to_pylist(), batch.column("best").to_pylist())
            texts = [Page(h.as_py()).text(p, b) for h, p, b in taken]
            made = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
