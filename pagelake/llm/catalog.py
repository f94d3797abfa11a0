"""Registered queries of the dealt operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pagelake.llm import arc, bestbin, budget, consensus, manifest, maxent, neardup, packing, superkmer, templates, tokens, toxicity, whitening
from pagelake.llm.text import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document for the byte-level vocabulary of 50,257 ids."""
    return tokens.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 85 % alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Shape(shingle=3, percent=85))


WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# every pair that shares a shingle, and components by following links until nothing is new
ORACLE["op2_near_duplicates"] = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(_LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, root = doc_id AS kept
FROM (SELECT id AS doc_id, min(root) AS root FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""


@query
def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of the documents outside the held-out fold."""
    return maxent.scores(table(spark, sf_dir, "documents"))


@query
def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, as written or with other numbers, names and units."""
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


@query
def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, taken from ARC files, converted to WARC files and read back."""
    read = arc.convert(arc.as_arc(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Share of the corpus, passes and weights of the mixture; a source's domain is its number modulo 4.
MIXTURE = budget.Plan(
    percent=60,
    epochs=2,
    weights=(
        ("domain", "d0", 4), ("domain", "d1", 3), ("domain", "d2", 2), ("domain", "d3", 1),
        ("lang", "en", 4), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 2),
    ),
)


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.when(number != "", F.concat(F.lit("d"), number.cast("int") % 4)).otherwise("other"))


@query
def op6_token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken, and how often, to reach the mixture's weights."""
    return budget.select_tokens(with_domain(table(spark, sf_dir, "documents")), MIXTURE).drop("key")


ORACLE["op6_token_budgets"] = budget.oracle(
    MIXTURE,
    "SELECT *, CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{1,9}$') "
    "THEN 'd' || (regexp_extract(source, '([0-9]{1,9})$', 1)::INT % 4) ELSE 'other' END AS domain FROM documents",
)


@query
def op7_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document without the 50-word windows that an earlier document holds."""
    return superkmer.repeated_words(table(spark, sf_dir, "documents")).drop("key")


ORACLE["op7_repeated_windows"] = f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
low AS (SELECT t, min(doc_id) AS m FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM win JOIN low USING (t) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, CAST(generate_subscripts(w, 1) AS BIGINT) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY word.pos) AS t FROM word LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query
def op8_best_bin_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth vector by inner product."""
    return bestbin.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the paths that its host's pages agree on."""
    return consensus.main_text(table(spark, sf_dir, "pages"))


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered copy of it folds to."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(fold(docs, 7, 0), F.try_add("n_chars", F.lit(1).cast("long"))).otherwise(F.col("n_chars"))
    return manifest.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "lang", {"n_chars": tampered})


def _leaf(n_chars: str) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR END"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC = (
    "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), "
    "lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"
)
_LEVELS = """SELECT {grp}lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {t} WHERE n > 1 GROUP BY {grp}lvl, pos // 2, n"""

# every node of every level, and each document's siblings from them
ORACLE["op12_merkle_manifest"] = f"""WITH RECURSIVE d AS (SELECT *, {_leaf('n_chars')} AS leaf,
  CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM d),
t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves UNION ALL {_LEVELS.format(grp='lang, ', t='t')}),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subs UNION ALL {_LEVELS.format(grp='', t='u')}),
way AS (SELECT r, a.lvl, a.pos & 1 AS side, b.h FROM leaves l JOIN t a ON a.lang IS NOT DISTINCT FROM l.lang AND a.n > 1 AND a.pos = l.pos >> a.lvl
    LEFT JOIN t b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL SELECT r, 1000 + a.lvl, a.pos & 1, b.h FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u a ON a.n > 1 AND a.pos = s.pos >> a.lvl
    LEFT JOIN u b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)),
ways AS (SELECT r, string_agg(h, '' ORDER BY lvl) AS proof, list(side || coalesce(h, '') ORDER BY lvl) AS steps FROM way GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT l.doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, proof,
  list_reduce([other] || coalesce(steps, []), lambda a, s: sha256(CASE s[1] WHEN '1' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN ways USING (r))"""


@query
def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of every usable vector, in units of 1/64."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
