"""HTML to columns without a DOM: one regular scan per page, no shuffle.

A page is cut once into pieces that cover it: comments, blocks of raw text (scripts and the like), tags,
and the text between them. The scan is linear. An opener of a comment or raw block that nothing closes takes
the rest of the page; that rest is then scanned again without its kind, as a bare start tag, so each kind costs
one more pass at most. What follows the last ">" holds no tag and is not scanned. Blocks that may be nested (nav,
footer) are removed from the innermost outwards, 64 levels deep; one that is never closed counts as a bare tag.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import let

# What stands between a tag's name and its ">": a quote after "=" hides a ">". The
# possessive loops need no stack and give up at once on a tag that the page's end cuts off.
INSIDE = r"""[^>=]*+(?:=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+[^>=]*+)*+"""

# Blocks whose content is raw text: markup inside them, or inside comments, is not seen.
RAW = ("script", "style", "iframe")
TAG_NAME = r"^<([A-Za-z][A-Za-z0-9:-]*)"
OPEN_TAG = rf"^<[A-Za-z]{INSIDE}>"
ATTRIBUTE = r"([A-Za-z_:][A-Za-z0-9_:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
ATTRIBUTES = ("src", "href", "class", "alt", "width", "height", "poster", "http-equiv")
TAGS = ("script", "iframe", "a", "img", "video", "source", "link", "meta")

CRAWL_DROP = ("script", "style", "nav", "footer")
INDEX_DROP = ("script", "style")

ENTITY = r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)"
# numbers and the old names also count without a semicolon, except in attributes
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
LOOSE_ENTITY = rf"&(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|{'|'.join(_OLD_NAMES)})"
# name or number -> code point, from the tables of the standard library; the numbers
# 128 to 159 mean the Windows characters
_NAMED = {**name2codepoint, "apos": 39, **{n: ord(html5[n]) for n in _OLD_NAMES}}
_NUMBERED = {str(i): ord(bytes([i]).decode("cp1252", "replace")) for i in range(128, 160)}
_CODES = ",".join(f"{k}:{v}" for k, v in {**_NAMED, **_NUMBERED}.items())


def _entity_text(name: Column) -> Column:
    """Text of one entity given without "&" and ";"; null when there is no such name."""
    hexed = F.regexp_replace(F.substring(name, F.lit(3), F.length(name)), "^0+(?=.)", "")
    number = F.when(name.rlike("^#[xX]"), F.when(F.length(hexed) > 8, "0").otherwise(F.conv(hexed, 16, 10))).when(
        name.startswith("#"), F.regexp_replace(F.substring(name, F.lit(2), F.length(name)), "^0+(?=.)", "")
    )
    listed = F.try_element_at(F.str_to_map(F.lit(_CODES)), F.coalesce(number, name))
    code = F.coalesce(listed, number).try_cast("int")
    broken = code.isNull() | (code > 0x10FFFF) | (code < 1) | code.between(0xD800, 0xDFFF)
    safe = F.when(broken, F.lit(0xFFFD)).otherwise(code)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.when(number.isNotNull() | listed.isNotNull(), char)


def decode_entities(text: Column, pattern: str = LOOSE_ENTITY) -> Column:
    """Decode numbered and named entities inside the JVM, in one pass over the text."""

    def decoded(t: Column) -> Column:
        chars = F.transform(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(1)),
            lambda n: F.coalesce(_entity_text(F.rtrim(n, F.lit(";"))), F.concat(F.lit("&"), n)),
        )
        pieces = F.zip_with(F.split(t, pattern, -1), chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.array_join(pieces, "")

    return F.when(text.contains("&"), let(text, decoded)).otherwise(text)


def _cover(kinds: tuple[str, ...]) -> str:
    """Pattern of the pieces of a page; a comment or raw block ends at its close or with the page."""
    blocks = [r"<!--.*?(?:-->|\z)" if k == "!--" else rf"<{k}\b{INSIDE}>.*?(?:</{k}\s*+>|\z)" for k in kinds]
    return "(?is)" + "|".join([*blocks, rf"</?[A-Za-z]{INSIDE}>", "<![A-Za-z][^>]*+>", "[^<]++", "<"])


def pieces(html: Column, raw: tuple[str, ...] = RAW) -> Column:
    """The page as an array of comments, raw blocks, tags and texts in order; joined they are the page."""
    kinds = ("!--", *raw)
    patterns = F.array(*[F.lit(_cover(tuple(k for i, k in enumerate(kinds) if not mask >> i & 1))) for mask in range(1 << len(kinds))])

    def unclosed(piece: Column, mask: Column) -> Column:
        """Bit of the kind that the last piece opens and does not close; 0 if there is none."""
        found = F.lit(0)
        for i, k in enumerate(kinds):
            if k == "!--":
                hangs = piece.startswith("<!--") & ~(piece.endswith("-->") & (F.length(piece) >= 7))
            else:
                hangs = piece.rlike(rf"(?i)^<{k}\b") & ~piece.rlike(rf"(?i)</{k}\s*+>$")
            found = F.when(hangs & (mask.bitwiseAND(1 << i) == 0), F.lit(1 << i)).otherwise(found)
        return F.coalesce(found, F.lit(0))

    def step(a: Column, _: Column) -> Column:
        def split(found: Column) -> Column:
            return let(
                unclosed(F.try_element_at(found, F.lit(-1)), a["mask"]),
                lambda bit: F.when(
                    bit > 0, state(F.concat(a["done"], F.slice(found, F.lit(1), F.size(found) - 1)), F.element_at(found, -1), a["mask"].bitwiseOR(bit))
                ).otherwise(state(F.concat(a["done"], found), F.lit(None).cast("string"), a["mask"])),
            )

        return F.when(a["rest"].isNull(), a).otherwise(let(F.regexp_extract_all(a["rest"], F.get(patterns, a["mask"]), F.lit(0)), split))

    def state(done: Column, rest: Column, mask: Column) -> Column:
        return F.struct(done.alias("done"), rest.alias("rest"), mask.alias("mask"))

    def scan(tail: Column) -> Column:
        head = F.substring(html, F.lit(1), F.length(html) - F.length(tail))
        start = state(F.array().cast("array<string>"), F.when(head != "", head), F.lit(0))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(len(kinds))), start, step)["done"]
        return F.when(tail != "", F.concat(done, F.array(tail))).otherwise(done)

    return F.when(html.isNotNull(), let(F.substring_index(html, ">", -1), scan))


#: Characters that stand for the open and close tags of blocks that may be nested (no text holds them, they are
#: no characters of Unicode), the one between kept tags, and the levels of nesting that are looked at.
MARKS = {"nav": ("\ufdd0", "\ufdd1"), "footer": ("\ufdd2", "\ufdd3")}
BETWEEN, LEVELS = "\ufdd4", 64
_ALL_MARKS = "".join(a + b for a, b in MARKS.values())
_INNERMOST = "|".join(f"{a}[^{a}{b}]*+{b}" for a, b in MARKS.values())


def _marked(piece: Column, other: Callable[[Column], Column]) -> Column:
    """The mark of a piece that opens or closes a nested block, else what ``other`` makes of it."""
    made = F.lit(None).cast("string")
    for tag, (opens, closes) in MARKS.items():
        made = F.when(piece.rlike(rf"(?i)^<{tag}\b"), opens).when(piece.rlike(rf"(?i)^</{tag}\b"), closes).otherwise(made)
    return F.coalesce(F.when(piece.startswith("<"), made), other(piece))


def _balanced(marked: Column) -> Column:
    """Marked text without its blocks, innermost first, and without marks that have no partner."""
    state = F.struct(marked.alias("text"), F.lit(True).alias("more"))

    def step(a: Column, _: Column) -> Column:
        new = F.regexp_replace(a["text"], _INNERMOST, " ")
        return F.when(a["more"], F.struct(new.alias("text"), (new != a["text"]).alias("more"))).otherwise(a)

    return F.translate(F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), state, step)["text"], _ALL_MARKS, " " * len(_ALL_MARKS))


def tokens_outside(html: Column) -> Column:
    """Start tags that are not inside a nav or footer, in document order."""
    kept = F.transform(pieces(html), lambda p: _marked(p, lambda q: F.when(is_token(q), F.concat(q, F.lit(BETWEEN))).otherwise("")))
    parts = F.split(_balanced(F.array_join(kept, "")), BETWEEN)
    return F.filter(F.transform(parts, lambda t: F.ltrim(t)), lambda t: t != "")


def page_text(html: Column, drop: tuple[str, ...] = CRAWL_DROP) -> Column:
    """Text nodes joined by one space, without comments and the dropped blocks (raw ones, and nav with footer)."""
    tail = F.substring_index(html, ">", -1)  # the last piece may hold any character, but no tag
    found = pieces(F.substring(html, F.lit(1), F.length(html) - F.length(tail)), tuple(t for t in drop if t in RAW))
    plain = lambda p: F.when(p.startswith("<") & (p != "<"), " ").otherwise(p)
    if set(drop) >= set(MARKS):
        text = _balanced(F.array_join(F.transform(found, lambda p: _marked(p, plain)), ""))
    else:
        text = F.array_join(F.transform(found, plain), "")
    flat = F.trim(F.regexp_replace(F.concat(text, tail), r"[ \t\r\n\f]+", " "))
    return decode_entities(flat)


TITLE = rf"(?is)^<title\b{INSIDE}>(.*)</title\s*>$"


def title(html: Column, url: Column) -> Column:
    """Text of the first title element, else the address."""
    first = F.get(F.filter(pieces(html, (*RAW, "title")), lambda p: p.startswith("<") & p.rlike(TITLE)), F.lit(0))
    found = let(F.regexp_extract(first, TITLE, 1), lambda t: decode_entities(t))
    return F.coalesce(F.nullif(found, F.lit("")), url)


def is_token(piece: Column) -> Column:
    """Whether a piece is a comment, raw block or start tag."""
    return piece.startswith("<") & piece.endswith(">") & piece.rlike("^<(?:[A-Za-z]|!--)")


def tokens(html: Column) -> Column:
    """Comments, raw blocks and start tags, in document order."""
    return F.filter(pieces(html), is_token)


def tag_of(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, TAG_NAME, 1))


def _unquote(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute_of(names: Column, values: Column, name: str) -> Column:
    """Value of an attribute; null when absent, '' when bare."""
    return F.get(values, F.array_position(names, F.lit(name)).cast("int") - 1)


def element(token: Column, pos: Column) -> Column:
    """Struct of one token: position, tag, attributes, script text, raw text."""

    def build(open_tag: Column) -> Column:
        names = F.regexp_extract_all(F.lower(open_tag), F.lit(ATTRIBUTE), F.lit(1))
        quoted = F.regexp_extract_all(open_tag, F.lit(ATTRIBUTE), F.lit(2))
        values = F.transform(quoted, lambda v: let(_unquote(v), lambda u: decode_entities(u, ENTITY)))
        pair = F.struct(names.alias("names"), values.alias("values"))
        return let(
            pair,
            lambda p: F.struct(
                pos.cast("int").alias("pos"),
                tag_of(token).alias("tag"),
                *[
                    attribute_of(p["names"], p["values"], a).alias(a.replace("-", "_"))
                    for a in ATTRIBUTES
                ],
                F.nullif(
                    F.regexp_extract(token, rf"(?is)^<script\b{INSIDE}>(.*)</script\s*>$", 1), F.lit("")
                ).alias("text"),
                token.alias("raw"),
            ),
        )

    return let(F.regexp_extract(token, OPEN_TAG, 0), build)


def elements(html: Column) -> Column:
    """Array of the elements the engine looks at (see TAGS)."""
    return elements_of(tokens(html))


def elements_of(found: Column) -> Column:
    """Elements of the tokens of a page."""
    placed = F.transform(found, lambda t, i: F.struct(t.alias("raw"), i.alias("pos"), tag_of(t).alias("tag")))
    wanted = F.filter(placed, lambda t: t["tag"].isin(*TAGS))
    return F.transform(wanted, lambda t: element(t["raw"], t["pos"]))
