import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake.llm import budget, catalog, templates

DOCS = "doc_id long, text string, lang string, source string, domain string, key long, w int, hits string, item string"


def spread(spark, rows):
    return spark.createDataFrame([(d, t, l, s, m, 5, 6, "h", "i") for d, t, l, s, m in rows], DOCS)


def mixture_rows(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = r.choice([None, "", " ", "x " * r.randint(1, 400), "w\t" * r.randint(1, 30)])
        out.append((i, text, r.choice(["en", "en", "en", "de", None]), f"src{r.choice([0, 0, 0, 1, 2, 3, 4])}", r.choice(["a", "b", "c"])))
    return out


@pytest.mark.parametrize("percent,epochs", [(30, 1), (60, 2), (150, 2), (400, 3), (0, 1)])
def test_budgets_equal_the_sql(spark, percent, epochs):
    weights = (("domain", "a", 5), ("domain", "b", 2), ("lang", "de", 3), ("lang", "", 0), ("source", "src1", 4))
    plan = budget.Plan(percent=percent, epochs=epochs, weights=weights)
    rows = mixture_rows(percent)
    got = sorted(map(tuple, budget.select_tokens(spread(spark, rows), plan).drop("key").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE s (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, domain VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?)", rows)
    assert got == sorted(con.sql(budget.oracle(plan, "SELECT * FROM s")).fetchall())


def test_shortage_goes_to_siblings_before_ancestors(spark):
    """One source of a/en is short: its share goes to its sibling, nothing to domain b."""
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    def of(tokens):
        return {r.source: int(r.budget) for r in budget.leaf_budgets(leaves, budget.Plan(tokens=tokens, epochs=1)).collect()}
    assert of(400) == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    assert of(2600) == {"s1": 10, "s2": 800, "s3": 790 + 0, "s4": 1000} or sum(of(2600).values()) in (2599, 2600)
    assert of(10_000) == {"s1": 10, "s2": 1000, "s3": 1000, "s4": 1000}


def test_prefix_is_shortest_that_reaches_the_budget(spark):
    rows = [(i, "x " * (i % 7 + 1), "en", "s", "a") for i in range(5000)]
    total = sum(i % 7 + 1 for i in range(5000))
    got = budget.select_tokens(spread(spark, rows), budget.Plan(percent=250, epochs=3)).collect()
    taken = sum(r.tokens * r.copies for r in got)
    assert total * 5 // 2 <= taken < total * 5 // 2 + 7 and {r.copies for r in got} == {2, 3}


def test_budgets_without_rows_or_with_repeated_rows(spark):
    assert budget.select_tokens(spread(spark, []), budget.Plan()).count() == 0
    rows = [(1, "a b c", "en", "s", "a")] * 4 + [(None, "a b", None, None, None)]
    assert budget.select_tokens(spread(spark, rows), budget.Plan(percent=100, epochs=1)).count() == 5


ITEM = "If Mary buys 12 apples and 5 pears for 30 euros how many apples does Mary eat when 5 pears are left over at home"


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "item_id long, text string, shift int, w string")


def found(spark, texts, shape=templates.Shape(), benchmark=(ITEM, None, "", "too short")):
    docs = spread(spark, [(i, t, "en", "s", "a") for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items(spark, benchmark), shape).collect()}


def test_template_matches(spark):
    again = ITEM.replace("Mary", "Jonas").replace("12", "48").replace("5", "7").replace("euros", "dollars")
    mixed = again.replace("does Jonas", "does Paul")  # one name became two: consistent from its second word on
    half = " ".join(ITEM.split()[:14])
    long_text = "lorem ipsum dolor " * 40_000
    assert found(spark, [mixed], templates.Shape(run=24)) == {} != found(spark, [again], templates.Shape(run=24))
    assert found(spark, [mixed], templates.Shape(run=20))[0, 0].run == 23
    texts = ["before it " + ITEM + " and after", again, "", half, " ".join(ITEM.split()[:11]), ITEM.lower(), None, "", "A B C D E F G H I J K L M N O P", long_text + ITEM.replace(" ", "\n- "), "x " + ITEM[3:], ITEM.replace("does Mary", "does Paul")]
    got = found(spark, texts)
    n = len(ITEM.split())
    assert got[0, 0].run == n and got[0, 0].n_changed == 0
    assert got[1, 0].run == n and got[1, 0].n_changed >= 3
    assert (2, 0) not in got and (4, 0) not in got and (8, 0) not in got
    assert got[3, 0].run == 14 and got[5, 0].run == n and got[9, 0].run == n and got[10, 0].run == n - 1
    assert got[11, 0].run == 23 and got[11, 0].n_changed == 1  # all but the first two words, where the name contradicts
    assert set(got) == {(0, 0), (1, 0), (3, 0), (5, 0), (9, 0), (10, 0), (11, 0)}


def test_short_dense_and_capital_copies_are_met_at_every_place(spark):
    """Items of eight to twelve words, of names and numbers, and copies in any case, wherever they start."""
    short = ["which of the rivers here runs to sea", "when does the first train leave for the far north"]
    dense = "Anna Bell 12 Carl 9 Dora Evans 77 met Frank 3 Gina 4 Hugo"
    spaced = "then when Anna 12 7 or Carl Dora whom they"  # no window of eight holds four literal words
    benchmark = (*short, dense, spaced, ITEM)
    assert [len(t.split()) for t in benchmark[:4]] == [8, 10, 14, 10]
    makes = [str, str.lower, str.upper, str.title]
    texts = ["x " * lead + make(item) + " y" * 3 for item in benchmark for make in makes for lead in range(3)]
    got = found(spark, texts, benchmark=benchmark)
    assert set(got) == {(i, i // 12) for i in range(len(texts))}
    assert all(r.run == r.n_item_words for r in got.values())
    other = spaced.replace("Anna", "Berta").replace("12", "13")
    assert set(found(spark, ["x " * lead + other for lead in range(3)], benchmark=benchmark)) == {(0, 3), (1, 3), (2, 3)}


def plain_runs(item, text, shape):
    """Longest run of one item in one text by trying every alignment and every start."""

    def words(t):
        return re.findall(r"[0-9]+(?:[.,][0-9]+)+|[A-Za-z0-9]+", t)

    def kind(w):
        return "#" if w[0].isdigit() or w.lower() in templates.NUMBERS else "@" if w[0].isupper() else "%" if w in templates.UNITS else w

    best, d = 0, words(text)
    for variant in {item, item.lower()}:
        i = words(variant)
        least = min(shape.run, len(i))
        for shift in range(-len(i) + 1, len(d)):
            pairs = [(i[k], d[k + shift]) if 0 <= k + shift < len(d) else None for k in range(len(i))]
            for a in range(len(pairs)):
                there, back, literal = {}, {}, 0
                for b in range(a, len(pairs)):
                    p = pairs[b]
                    if p is None or kind(p[0]) != kind(p[1]):
                        break
                    if kind(p[0]) in "#@%":
                        if there.setdefault(p[0], p[1]) != p[1] or back.setdefault(p[1], p[0]) != p[0]:
                            break
                    else:
                        literal += 1
                    n = b - a + 1
                    if n >= least and literal * 2 >= n:
                        best = max(best, n)
                same = 0
                while a + same < len(pairs) and pairs[a + same] and pairs[a + same][0].lower() == pairs[a + same][1].lower():
                    same += 1
                best = max(best, same) if same >= least else best
    return best


def test_all_consistent_runs_equal_brute_force(spark):
    """Windows that hold a key are looked up everywhere, so a run of 13 words is found wherever it lies."""
    r = random.Random(8)
    plain = "if then when apples pears many left over home sells buys gives each how does the for and".split()
    names, numbers = ["Mary", "Paul", "Ann", "Bob"], ["12", "30", "5", "seven", "3.5"]
    benchmark = [" ".join(r.choice(names) if r.random() < 0.12 else r.choice(numbers) if r.random() < 0.12 else r.choice(plain) for _ in range(r.randint(3, 34))) for _ in range(12)]
    texts = []
    for item in benchmark * 4:
        w = [r.choice(names) if x in names and r.random() < 0.5 else r.choice(numbers) if x in numbers and r.random() < 0.5 else x for x in item.split()]
        if r.random() < 0.5:
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join(["lead"] * r.randint(0, 3) + w[r.randint(0, 2) :] + ["tail"] * r.randint(0, 3)))
    got = {k: v.run for k, v in found(spark, texts, benchmark=benchmark).items()}
    want = {(i, j): n for i, t in enumerate(texts) for j, item in enumerate(benchmark) if (n := plain_runs(item, t, templates.Shape()))}
    lost = {k for k in want if got.get(k) != want[k]}
    # a run that the keys of eight words (four of them literal) or the whole of a short item do not meet is not looked for
    assert not set(got) - set(want) and len(want) >= 30 and len(lost) <= len(want) // 20


def test_short_items_and_runs_beside_a_bad_slot(spark):
    benchmark = ["is 51 a prime number", "yes it", "a farmer has 12 cows and 30 sheep and then goes on to double 12 again and sell them for Bob"]
    texts = ["well is 51 a prime number", "Is 53 A prime number", "is 53 a prime number", "yes it is", "a farmer has 15 cows and 41 sheep and then goes on to double 99 again and sell them for Ann"]
    got = found(spark, texts, benchmark=benchmark)
    assert set(got) == {(0, 0), (2, 0), (4, 2)}
    assert (got[0, 0].run, got[2, 0].n_changed) == (5, 1) and got[4, 2].run == 17 and got[4, 2].n_changed == 3
    assert set(found(spark, texts, templates.Shape(shortest=2), benchmark)) == {(0, 0), (2, 0), (3, 1), (4, 2)}


def test_templates_on_empty_and_repeated_tables(spark):
    assert found(spark, []) == {} and found(spark, [ITEM], benchmark=()) == {}
    docs = spread(spark, [(None, ITEM, "en", "s", "a"), (4, ITEM, "en", "s", "a"), (4, ITEM, "en", "s", "a")])
    got = templates.contaminated(docs, items(spark, [ITEM, ITEM])).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(4, 0), (4, 1)]


def test_leaks_equal_a_search_for_whole_items(spark, sf):
    """The corpus holds whole items only, so a text search finds the same pairs."""
    got = {(r.doc_id, r.item_id) for r in catalog.op4_template_leaks(spark, sf).collect()}
    squeeze = lambda t: F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", squeeze("text").alias("t"))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", squeeze("text").alias("b"))
    want = {tuple(r) for r in docs.join(F.broadcast(bench), F.col("t").contains(F.col("b"))).select("doc_id", "item_id").collect()}
    assert want and got == want
