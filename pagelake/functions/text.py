"""Words, keywords and per-document term runs, computed inside one row.

All of it is a narrow stage: a document is tokenised, counted and ranked where it
was read, so no token ever crosses the network.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import let

KEYWORD_TOKEN = r"[\p{L}\p{N}_]{%d,}"
INDEX_TOKEN = r"[\p{L}\p{N}]+"
NO_TOKEN = r"[^\p{L}\p{N}]+"
# all white space of Unicode, hard spaces included
GAP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Fixed values for optional accent folding (Latin letters of the supported languages).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿß"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyys"


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def keyword_tokens(text: Column, min_chars: int = 3) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_TOKEN % min_chars), F.lit(0))


def index_tokens(text: Column, fold_accents: bool = False) -> Column:
    lowered = F.lower(text)
    if fold_accents:
        lowered = F.translate(lowered, ACCENTED, UNACCENTED)
    return F.regexp_extract_all(lowered, F.lit(INDEX_TOKEN), F.lit(0))


def spaced_tokens(text: Column, fold_accents: bool = False) -> Column:
    """The tokens of ``index_tokens`` as one text with spaces between (and perhaps around) them."""
    lowered = F.lower(text)
    if fold_accents:
        lowered = F.translate(lowered, ACCENTED, UNACCENTED)
    return F.regexp_replace(lowered, NO_TOKEN, " ")


def spaced_count(spaced: Column) -> Column:
    """Number of tokens of a text of ``spaced_tokens``."""
    trimmed = F.trim(spaced)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


@lru_cache(maxsize=8)
def stop_words(languages: tuple[str, ...]) -> tuple[str, ...]:
    """Stop-word lists shipped with Spark ML (fixed, a few hundred words)."""
    from pyspark.ml.feature import StopWordsRemover

    SparkSession.builder.getOrCreate()  # the lists are read through the JVM
    words: set[str] = set()
    for language in languages:
        words.update(StopWordsRemover.loadDefaultStopWords(language))
    return tuple(sorted(words))


def without_stop_words(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words))


def runs_of(located: Column) -> Column:
    """Group array<struct<term, pos>> of one document by term; not for empty arrays."""

    def from_sorted(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]),
        )

        def cut(b: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                length = F.coalesce(F.get(b, k + 1), F.size(s)) - start
                return F.struct(
                    F.get(s, start)["term"].alias("term"),
                    length.cast("long").alias("tf"),
                    F.transform(F.slice(s, start + 1, length), lambda x: x["pos"]).alias("positions"),
                )

            return F.transform(b, run)

        return let(starts, cut)

    return let(F.sort_array(located), from_sorted)


def term_runs(tokens: Column) -> Column:
    """array<struct<term, tf, positions>> sorted by term, positions ascending."""
    located = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    empty = F.array().cast("array<struct<term:string,tf:bigint,positions:array<int>>>")
    return F.when(F.size(tokens) > 0, runs_of(located)).otherwise(empty)


def keywords(text: Column, cfg: Settings = DEFAULT) -> Column:
    """array<struct<rank, word, n>>: most frequent words, ties by first appearance."""
    words = without_stop_words(keyword_tokens(text, cfg.min_keyword_chars), stop_words(cfg.stop_languages))

    def ranked(runs: Column) -> Column:
        order = F.array_sort(
            F.transform(
                runs,
                lambda r: F.struct((-r["tf"]).alias("neg"), F.get(r["positions"], F.lit(0)).alias("first"), r["term"].alias("word")),
            )
        )
        top = F.slice(order, 1, cfg.max_keywords)
        return F.transform(
            top, lambda r, i: F.struct((i + 1).alias("rank"), r["word"].alias("word"), (-r["neg"]).alias("n"))
        )

    return let(let(words, term_runs), ranked)


def keyword_text(text: Column, cfg: Settings = DEFAULT) -> Column:
    return F.array_join(F.transform(keywords(text, cfg), lambda k: k["word"]), " ")
