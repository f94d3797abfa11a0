import re
from collections import Counter

from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions.stem import porter_stem
from pagelake.operators import index as I


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_keywords_fixture(spark):
    got = one(spark, "The cat sat. Cat dog; DOG dog le chat", T.keywords(F.col("t")))
    assert [(k.word, k.n, k["rank"]) for k in got] == [("dog", 3, 1), ("cat", 2, 2), ("sat", 1, 3), ("chat", 1, 4)]
    assert one(spark, "le la", T.keywords(F.col("t"))) == []


def test_runs_equal_a_counter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("text", T.term_runs(T.index_tokens(F.col("text"))).alias("runs")).collect()
    for r in rows:
        words = [w for w in re.findall(r"[^\W_]+", r.text.lower())]
        assert {x.term: x.tf for x in r.runs} == dict(Counter(words))
        for x in r.runs:
            assert all(words[p] == x.term for p in x.positions) and x.positions == sorted(x.positions)


def test_word_count_and_folding(spark):
    text = "  a b\n c\u00a0d\u2003e\x1cf "
    assert one(spark, text, T.word_count(F.col("t"))) == len(text.split()) == 6
    assert one(spark, "Été naïf", T.index_tokens(F.col("t"), True)) == ["ete", "naif"]
    assert one(spark, "", T.term_runs(T.index_tokens(F.col("t")))) == []


# examples of the published algorithm
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "is": "is", "élans": "élans",
}


def test_porter_examples(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    got = {r.w: r.s for r in df.select("w", porter_stem(F.col("w")).alias("s")).collect()}
    assert got == STEMS


def test_stemmed_postings_merge_positions(spark):
    docs = spark.createDataFrame([(1, "hopping hop cats hops")], "d long, t string")
    got = I.stem_postings(I.postings(docs, "d", ["t"]), "d").collect()
    assert {(r.term, r.tf, tuple(r.positions)) for r in got} == {("hop", 3, (0, 1, 3)), ("cat", 1, (2,))}


def test_a_first_y_is_a_consonant(spark):
    """Stems worked out by hand from the paper's rules."""


    want = {"ying": "ying", "yed": "yed", "yly": "yly", "ypres": "ypre", "yes": "ye", "yelling": "yell", "syzygy": "syzygi", "happy": "happi", "sky": "sky", "toyed": "toi"}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r.w: r.s for r in df.select("w", porter_stem(F.col("w")).alias("s")).collect()} == want
