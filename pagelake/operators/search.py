"""Batches of full-text searches with BM25 (Robertson & Zaragoza, 2009).

A search batch is a table (query_id, query). Matching works on one row per document
that lists the document's occurrences of all searched terms, so conjunctions, phrases
and exclusions are tests inside a row. A conjunction is joined on its rarest term only:
frequent terms never multiply the candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import explode_rows, half_up, let
from pagelake.functions import text as T
from pagelake.operators.index import Hits
from pagelake.operators.ranked import top_per_group
from pagelake.sources.store import is_small, materialise


def parse(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add the token list of each query and its distinct terms."""
    return queries.withColumn("phrase", T.index_tokens(F.col(query))).withColumn(
        "terms", F.array_distinct("phrase")
    )


def terms_of(parsed: DataFrame, *columns: str) -> DataFrame:
    """Distinct terms of the given array columns (default: terms)."""
    arrays = [F.col(c) for c in (columns or ("terms",))]
    return parsed.select(F.explode(F.concat(*arrays)).alias("term")).distinct()


def idf(df: Column, n_docs: Column, cfg: Settings = DEFAULT) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(cfg.bm25_min_idf))


def term_weight(idf_: Column, tf: Column, dl: Column, avg_dl: Column, cfg: Settings = DEFAULT) -> Column:
    norm = 1 - cfg.bm25_b + cfg.bm25_b * dl / avg_dl
    return idf_ * tf * (cfg.bm25_k1 + 1) / (tf + cfg.bm25_k1 * norm)


def _shrink(parsed: DataFrame):
    """Broadcast hint for tables derived from the query batch, if the batch is small.

    Their rows are terms of the queries, so the size of the batch bounds them all.
    """
    return F.broadcast if is_small(parsed) else (lambda df: df)


def _weighted(parsed: DataFrame, hits: Hits, cfg: Settings, shrink) -> DataFrame:
    """(query_id, term, df, idf), df 0 for terms found nowhere."""
    rows = parsed.select("query_id", F.explode("terms").alias("term"))
    return (
        rows.join(shrink(hits.df), "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("idf", idf(F.col("df"), hits.n_docs, cfg))
    )


def _lookup(hits: Column, names: Column, term: Column, field: str) -> Column:
    return F.get(hits, F.array_position(names, term).cast("int") - 1)[field]


def _phrase_starts_somewhere(hits: Column, names: Column, phrase: Column) -> Column:
    first = _lookup(hits, names, F.get(phrase, F.lit(0)), "positions")
    return F.exists(
        first,
        lambda p: F.forall(
            F.transform(phrase, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
            lambda w: F.array_contains(_lookup(hits, names, w["t"], "positions"), p + w["i"]),
        ),
    )


def _query_weights(parsed: DataFrame, hits: Hits, cfg: Settings, shrink) -> DataFrame:
    """(query_id, weights array<struct<df, term, idf>>), rarest term first."""
    return (
        _weighted(parsed, hits, cfg, shrink)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "term", "idf"))).alias("weights"))
    )


def _row_score(weights: Column, cfg: Settings) -> Column:
    """BM25 of a document row that has hits, names, dl and avg_dl."""

    def add(acc: Column, w: Column) -> Column:
        tf = _lookup(F.col("hits"), F.col("names"), w["term"], "tf")
        return acc + F.coalesce(term_weight(w["idf"], tf, F.col("dl"), F.col("avg_dl"), cfg), F.lit(0.0))

    return half_up(F.aggregate(weights, F.lit(0.0), add))


def match_all(
    parsed: DataFrame,
    hits: Hits,
    cfg: Settings = DEFAULT,
    phrase: str | None = None,
    none_of: str | None = None,
) -> DataFrame:
    """(query_id, doc_id, score): documents with every term of the query.

    ``phrase`` names an array column whose words must follow each other;
    ``none_of`` one whose words must be absent. Both must be among the scanned terms.
    """
    shrink = _shrink(parsed)
    per_query = (
        _query_weights(parsed, hits, cfg, shrink)
        .withColumn("rarest", F.get("weights", F.lit(0))["term"])
        # a term found nowhere leaves nothing to match
        .filter(F.get("weights", F.lit(0))["df"] > 0)
    )
    extra = [c for c in (phrase, none_of) if c]
    if extra:
        per_query = per_query.join(parsed.select("query_id", *extra), "query_id")
    candidates = (
        hits.docs.withColumn("names", F.transform("hits", lambda h: h["term"]))
        .withColumn("rarest", F.explode("names"))
        .join(shrink(per_query), "rarest")
        .filter(F.size(F.array_except(F.transform("weights", lambda w: w["term"]), "names")) == 0)
    )
    if phrase:
        candidates = candidates.filter(_phrase_starts_somewhere(F.col("hits"), F.col("names"), F.col(phrase)))
    if none_of:
        candidates = candidates.filter(~F.arrays_overlap("names", F.col(none_of)))
    scored = candidates.withColumn("avg_dl", hits.avg_dl)
    return scored.select("query_id", "doc_id", _row_score(F.col("weights"), cfg).alias("score"))


def match_any(parsed: DataFrame, hits: Hits, cfg: Settings = DEFAULT) -> DataFrame:
    """(query_id, doc_id, n_matched, score): documents with at least one term."""
    shrink = _shrink(parsed)
    weights = _weighted(parsed, hits, cfg, shrink).filter("df > 0").select("query_id", "term", "idf")
    return _score_all(hits, shrink(weights), cfg)


def _score_all(hits: Hits, weights: DataFrame, cfg: Settings, shard: Column | None = None) -> DataFrame:
    """Documents are partitioned once; the sums per (query, document) then need no
    further shuffle. A shard is worked out once per document."""
    extra = [] if shard is None else ["shard"]
    docs = hits.docs.repartition("doc_id")
    rows = (
        (docs if shard is None else docs.withColumn("shard", shard))
        .select("doc_id", "dl", *extra, F.explode("hits").alias("h"))
        .select("doc_id", "dl", *extra, F.col("h.term").alias("term"), F.col("h.tf").alias("tf"))
        .join(weights, "term")
        .withColumn("avg_dl", hits.avg_dl)
    )
    return _sums(rows, cfg, extra)


def _sums(rows: DataFrame, cfg: Settings, extra: Sequence[str] = ()) -> DataFrame:
    weight = term_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avg_dl"), cfg)
    sums = rows.groupBy("doc_id", "query_id", *extra).agg(F.count("*").alias("n_matched"), F.sum(weight).alias("score"))
    return sums.select("query_id", "doc_id", "n_matched", half_up(F.col("score")).alias("score"), *extra)


def top_any(
    parsed: DataFrame,
    hits: Hits,
    k: int,
    cfg: Settings = DEFAULT,
    shard: Column | None = None,
    n_shards: int = 1,
    slack: int = 20,
    plain_rows: int = 50_000_000,
    gain: float = 20,
) -> DataFrame:
    """First k documents of each query that have at least one of its terms; exact.

    With ``shard`` (an expression over doc_id) the first k of each shard. Up to
    ``plain_rows`` matches of a term and a document are scored directly. Beyond that,
    scoring all documents that share a frequent word with a query would emit nearly all
    pairs. A term adds at most idf * (k1 + 1), so the rarest term a document has bounds its
    whole score. Documents with the rarest terms are scored first; their k-th score
    then tells which frequent terms cannot lift a document into the list any more. Finding the
    documents of a term costs more there than scoring does, so this is done only if it leaves out all but
    one in ``gain`` matches; else all are scored.
    """
    group = ["query_id"] + (["shard"] if shard is not None else [])
    shrink = _shrink(parsed)
    weights = _query_weights(parsed, hits, cfg, shrink).withColumn("weights", F.filter("weights", lambda w: w["df"] > 0))
    rows = weights.select("query_id", F.posexplode("weights").alias("i", "w"), "weights").select(
        "query_id",
        F.col("w.df").alias("df"),
        F.col("w.term").alias("term"),
        F.col("w.idf").alias("idf"),
        F.transform(F.slice("weights", F.lit(1), F.col("i")), lambda w: w["term"]).alias("rarer"),
        F.transform("weights", lambda w: w["term"]).alias("all_terms"),
        # documents found by the rarer terms, and the best score from this term on
        F.aggregate(F.slice("weights", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, w: a + w["df"]).alias("before"),
        F.aggregate(
            F.slice("weights", F.col("i") + 1, F.size("weights")), F.lit(0.0), lambda a, w: a + w["idf"] * (cfg.bm25_k1 + 1)
        ).alias("bound"),
    )
    rows = materialise(rows, "bounds")
    # each row lists the other terms of its query, so this table is checked itself
    shrink = _shrink(rows)
    of_query = shrink(rows.select("query_id", "term", "idf"))
    located = (lambda df: df) if shard is None else (lambda df: df.withColumn("shard", shard))
    matches = rows.agg(F.sum("df")).first()[0] or 0

    def plain() -> DataFrame:
        return top_per_group(_score_all(hits, of_query, cfg, shard), group, best_first(), k, "doc_id")

    if matches <= plain_rows:
        return plain()
    # partitioned once by document: the sums per (query, document) need no shuffle
    docs = hits.docs.repartition("doc_id").select(
        "doc_id", "dl", F.transform("hits", lambda h: h["term"]).alias("names"), F.transform("hits", lambda h: h["tf"]).alias("tfs")
    )

    def scored(terms: DataFrame) -> DataFrame:
        """Score documents that hold one of the (query_id, term) pairs."""
        found = (
            docs.withColumn("term", F.explode("names"))
            .join(shrink(terms.select("query_id", "term", "rarer", "all_terms")), "term")
            # a document counts once per query: at the rarest of its terms
            .filter(~F.arrays_overlap("names", "rarer"))
        )
        shared = F.array_intersect("names", "all_terms")
        each = explode_rows(found, ["query_id", "doc_id", "dl", "names", "tfs"], shared, "term")
        matched = each.select(
            "query_id", "doc_id", "dl", "term", F.get("tfs", F.array_position("names", F.col("term")).cast("int") - 1).alias("tf")
        )
        weighted = matched.join(of_query, ["query_id", "term"]).withColumn("avg_dl", hits.avg_dl)
        return located(_sums(weighted, cfg))

    seeds = rows.filter(F.col("before") < slack * k * n_shards)
    kth = top_per_group(scored(seeds), group, best_first(), k, "doc_id").filter(F.col("rank") == k)
    floor = kth.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floor = materialise(floor.filter(F.col("n") == n_shards).select("query_id", "least"), "floor")
    # bounds are compared with room for the rounding of scores
    needed = rows.join(floor, "query_id", "left").filter(
        F.col("least").isNull() | (F.col("bound") + 1e-5 >= F.col("least"))
    )
    if (needed.agg(F.sum("df")).first()[0] or 0) * gain > matches:
        return plain()
    return top_per_group(scored(needed), group, best_first(), k, "doc_id")


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def top(matches: DataFrame, k: int) -> DataFrame:
    """First k documents of each query over the whole store."""
    return top_per_group(matches, ["query_id"], best_first(), k, "doc_id")


def top_per_shard(matches: DataFrame, shard: Column, k: int) -> DataFrame:
    """First k documents of each query in each shard."""
    return top_per_group(matches.withColumn("shard", shard), ["query_id", "shard"], best_first(), k, "doc_id")


def page_rows(tops: DataFrame, page: int, per_page: int = DEFAULT.per_page) -> DataFrame:
    """One page out of ranked rows; page numbers start at 1."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    return tops.filter((F.col("rank") > (page - 1) * per_page) & (F.col("rank") <= page * per_page))


def merge_shards(shard_tops: DataFrame, k: int) -> DataFrame:
    """Merge the shard lists into one list per query."""
    return top(shard_tops.drop("rank", "shard"), k)


def page_of(matches: DataFrame, page: int, per_page: int = DEFAULT.per_page) -> DataFrame:
    """One result page per query."""
    return page_rows(top(matches, max(page * per_page, 1)), page, per_page)


def envelope(results: DataFrame, query: str, category: str = "all", page: int = 1) -> DataFrame:
    """Result rows with the request echoed; an empty query is an error."""
    if not query:
        raise ValueError("Missing query")
    return results.select(
        F.lit(query).alias("query"), F.lit(category).alias("category"), F.lit(page).alias("page"), *results.columns
    )


def excerpt(title: Column, terms: Column, words: int = DEFAULT.excerpt_words) -> Column:
    """Window of the title with most distinct hits, earliest first; hits in <b>, cuts as dots."""
    split = T.words(title)
    marked = F.transform(
        split,
        lambda w: let(
            F.array_intersect(T.index_tokens(w), terms),
            lambda found: F.struct(
                found.alias("found"),
                F.when(F.size(found) > 0, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w).alias("shown"),
            ),
        ),
    )

    def window(m: Column, start: Column) -> Column:
        return F.slice(m, start + 1, F.lit(words))

    def choose(m: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(m) - words, F.lit(0)))
        ranked = F.transform(
            starts,
            lambda s: F.struct(
                (-F.size(F.array_distinct(F.flatten(F.transform(window(m, s), lambda x: x["found"]))))).alias("n"),
                s.alias("start"),
            ),
        )
        return let(F.array_min(ranked)["start"], lambda s: show(m, s))

    def show(m: Column, s: Column) -> Column:
        body = F.array_join(F.transform(window(m, s), lambda x: x["shown"]), " ")
        return F.concat(
            F.when(s > 0, F.lit("...")).otherwise(F.lit("")),
            body,
            F.when(s + words < F.size(m), F.lit("...")).otherwise(F.lit("")),
        )

    return let(marked, choose)


PREFIX = "*"


def prefix_terms(tokens: Column) -> Column:
    """All beginnings of the tokens, each marked with a star: "ab" gives "a*", "ab*"."""
    return F.flatten(
        F.transform(
            tokens,
            lambda t: F.transform(
                F.sequence(F.lit(1), F.length(t)), lambda n: F.concat(F.substring(t, F.lit(1), n), F.lit(PREFIX))
            ),
        )
    )


def parse_prefix(queries: DataFrame, query: str = "query") -> DataFrame:
    """Queries whose last word is a beginning; shorter than two characters means none."""
    words = T.index_tokens(F.col(query))
    whole = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    last = F.concat(F.element_at(words, -1), F.lit(PREFIX))
    return queries.filter((F.length(query) >= 2) & (F.size(words) > 0)).withColumn(
        "terms", F.array_distinct(F.concat(whole, F.array(last)))
    )
