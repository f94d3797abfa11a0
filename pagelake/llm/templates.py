"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Words are numbers (with inner points and commas) and runs of letters and digits. A word that starts with a
digit or is a number word is a number, one that starts with a capital is a name, and a word of the unit list
is a unit; each becomes a typed placeholder. Eight consecutive placeholders or literal words make a window, and
windows are hash-joined with those of the benchmark items. Every item window with at least ``literals`` literal
words is a key (one fewer in items shorter than ``run``, so that any run that is reported holds a key), and so
are the lower-cased words of every window, by which copies in any case are met. An item of fewer words than a
window, but of ``shortest``, is one window of its own length; as a template it is a key if half of it is
literal. In the documents every window is looked up by both. A lower-cased copy of each item joins too, so that
a re-parameterised text without capitals is found. Before a window becomes a row its hash is looked up in a
bitmap of the keys' hashes, which passes every key and few others; the join after it is exact.

A hit fixes an alignment of document and item. The item is then laid over the whole text: literal
words must be equal and placeholders of one type, and the longest run of agreeing words counts. Over
this run the slots must be filled consistently: one filling for each original filling and back, as
in a question whose numbers and names were replaced throughout. Where they are not, all runs that are
consistent and cannot grow are compared and the longest counts. The pair is reported if the run has
at least ``run`` words (the whole item if that is shorter), half of them literal. Where no such run is longer,
as many words in a row that are equal but for case are a copy all the same, and are reported with no slots.

Null and empty texts and rows without an id match nothing; items of fewer than ``shortest`` words match
nothing. Rows that repeat an id and a text count once; repeated items are separate items. Of equal
runs the earliest alignment is reported. A name or number of several words is as many slots. Other columns are
not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import inline_rows, let
from pagelake.sources.store import broadcast_if_small, materialise

UNITS = (
    "mm cm dm km kg mg lb lbs oz ft yd mi mph kmh ml cl dl hz khz mhz ghz kb mb gb tb kw mw kwh "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit watt watts volt volts joule joules"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
WORD = r"\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}]+"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


class Shape(NamedTuple):
    """Words per window, least literal words of a key, least agreeing run, words of the shortest item."""

    window: int = 8
    literals: int = 4
    run: int = 13
    shortest: int = 3


def word_array(text: Column) -> Column:
    """Numbers, and letters and digits between anything else; empty for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def template(word: Column) -> Column:
    """The placeholder of a word's type, or the word itself."""
    head = F.substring(word, 1, 1)
    return (
        F.when(head.between("0", "9") | F.lower(word).isin(NUMBERS), NUMBER)
        .when(head != F.lower(head), NAME)
        .when(word.isin(UNITS), UNIT)
        .otherwise(word)
    )


def windows(words: Column, size: int) -> Column:
    """Hashes of the windows of an array of words in order: those of the templates, then those of the lower-cased words."""
    hashes = F.array(F.transform(words, lambda w: F.xxhash64(template(w))), F.transform(words, lambda w: F.xxhash64(F.lower(w), F.lit(1))))

    def made(h: Column) -> Column:
        last = F.size(h) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))

    # an array of the two names the hashes, so that they are computed once for all windows
    return F.flatten(F.transform(hashes, made))


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def item_windows(items: DataFrame, shape: Shape, size: int) -> DataFrame:
    """item, variant, at, n (words of the item) and key of the windows of one size that documents look up.

    A size below that of a window takes the items of just so many words.
    """
    kept = items.withColumn("w", F.transform("words", template)).select("item", "variant", "words", "w")
    kept = kept.filter(F.size("w") >= size if size == shape.window else F.size("w") == size)
    count = F.size("w") - size + 1
    rows = kept.select("item", "variant", "w", count.alias("count"), F.posexplode(windows(F.col("words"), size)).alias("i", "key"))
    at = F.pmod("i", "count")
    literal = F.size(F.filter(F.slice("w", at + 1, size), lambda w: ~is_slot(w)))
    least = F.when(F.size("w") < shape.run, shape.literals - 1).otherwise(shape.literals)
    least = F.when(F.size("w") < shape.window, F.ceil(F.size("w") / 2)).otherwise(least)
    # the lower-cased words of the item as written are those of its lower-cased copy
    wanted = F.when(F.col("i") < F.col("count"), literal >= least).otherwise(F.col("variant") == 0)
    return rows.filter(wanted).select("item", "variant", at.alias("at"), F.size("w").alias("n"), "key")


#: Bits of the bitmap per key, and its largest size (a larger table of keys is filtered less, not otherwise).
_BITS, _MOST_BITS = 32, 1 << 26


def bitmap(keys: DataFrame) -> tuple[Column, int]:
    """One constant array of 64-bit words in which the places of all keys are set, and the number of words.

    It passes through the driver: at most 8 MB, whatever the number of keys.
    """
    n = keys.select("key").distinct().count()
    words = max(64, 1 << (min(max(n, 1) * _BITS, _MOST_BITS) - 1).bit_length()) // 64
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col("key"), words))
    some = keys.groupBy(_word(F.col("key"), words).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(some, "word", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    made = row.select(F.to_json(F.transform("all", lambda x: x["bits"])).alias("bits")).first()["bits"]
    return F.from_json(F.lit(made), "array<bigint>"), words  # folded to a constant of the plan


def _word(hash_: Column, words: int) -> Column:
    return hash_.bitwiseAND(F.lit(words - 1)).cast("int")


def _place(hash_: Column, words: int) -> Column:
    return F.shiftrightunsigned(hash_, 58).cast("int")


def numbered_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, variant (0 as written, 1 lower-cased where that differs) and words."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    both = rows.withColumn("variant", F.lit(0)).unionByName(
        rows.filter("lower(text) <> text").withColumn("text", F.lower("text")).withColumn("variant", F.lit(1))
    )
    return both.select("item", "variant", word_array(F.col("text")).alias("words")).distinct()


def _agreement(shape: Shape) -> dict[str, Column]:
    """Columns over the doc words under the item (w), item words (words) and the shift between them."""
    pairs = F.transform("words", lambda x, k: F.struct(x.alias("i"), F.when(k + F.least("shift", F.lit(0)) >= 0, F.get("w", F.greatest(k + F.least("shift", F.lit(0)), F.lit(0)))).alias("d")))
    agree = F.transform("pairs", lambda p: F.when(template(p["i"]) == template(p["d"]), "1").otherwise("0"))
    equal = F.transform("pairs", lambda p: F.when(F.lower(p["i"]) == F.lower(p["d"]), "1").otherwise("0"))
    longest = F.array_max(F.transform(F.split("agree", "0"), lambda s: F.length(s)))
    verbatim = F.array_max(F.transform(F.split("equal", "0"), lambda s: F.length(s)))
    whole = F.struct(F.col("run"), F.expr("instr(agree, repeat('1', run)) - 1").alias("start"))
    return {
        "pairs": pairs,
        "agree": F.array_join(agree, ""),
        "equal": F.array_join(equal, ""),
        "run": longest,
        "verbatim": verbatim,
        "whole": whole,
    }


def _part(run: Column) -> Column:
    return F.when(run["run"] > 0, F.slice("pairs", run["start"] + 1, run["run"])).otherwise(F.slice("pairs", 1, 0))


def _slots(part: Column) -> Column:
    return F.array_distinct(F.filter(part, lambda p: is_slot(template(p["i"]))))


def _literal(part: Column) -> Column:
    return F.size(F.filter(part, lambda p: ~is_slot(template(p["i"]))))


def _one_to_one(slots: Column) -> Column:
    n = F.size(slots)
    return (F.size(F.array_distinct(F.transform(slots, lambda p: p["i"]))) == n) & (F.size(F.array_distinct(F.transform(slots, lambda p: p["d"]))) == n)


def longest_consistent(pairs: Column, least: Column) -> Column:
    """run and start of the longest run that agrees, is filled one to one and is half literal; null below ``least``.

    A pair begins a new run after itself if it does not agree, and after the last pair whose filling contradicts
    its own. The furthest such place so far is where the run that ends at a pair starts.
    """
    steps = F.transform(
        pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), F.coalesce(template(p["i"]) == template(p["d"]), F.lit(False)).alias("ok"), is_slot(template(p["i"])).alias("slot"))
    )

    def over(s: Column) -> Column:
        def after(p: Column, e: Column) -> Column:
            broken = F.transform(F.slice(s, F.lit(1), e), lambda q, j: F.when(q["ok"] & q["slot"] & ((q["i"] == p["i"]) != (q["d"] == p["d"])), j + 1).otherwise(0))
            return F.when(~p["ok"], e + 1).when(p["slot"], F.coalesce(F.array_max(broken), F.lit(0))).otherwise(0)

        zero = F.lit(0).cast("int")
        state = F.struct(zero.alias("start"), zero.alias("end"), F.struct(zero.alias("run"), zero.alias("start")).alias("best"))

        def add(a: Column, c: Column) -> Column:
            start, end = F.greatest(a["start"], c.cast("int")), a["end"] + 1
            run = end - start
            literal = F.size(F.filter(F.slice(s, start + 1, run), lambda q: ~q["slot"]))
            better = F.when((run > a["best"]["run"]) & (run >= least), literal * 2 >= run).otherwise(F.lit(False))
            best = F.when(better, F.struct(run.cast("int").alias("run"), start.cast("int").alias("start"))).otherwise(a["best"])
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), best.alias("best"))

        best = F.aggregate(F.transform(s, after), state, add)["best"]
        return F.when(best["run"] > 0, best)

    return let(steps, over)


def contaminated(docs: DataFrame, items: DataFrame, shape: Shape = Shape(), key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, key (xxhash64 of the text), item_id, run, n_item_words, n_slots and n_changed: matching pairs.

    The documents' windows are joined with the items' by broadcast if those are small (checked),
    else by a shuffled hash join of (hash, place) rows; text is shuffled once, to meet its hits.
    """
    items_ = materialise(numbered_items(items, key, text), "items")
    short = items_.select(F.size("words").alias("n")).filter(F.col("n").between(shape.shortest, shape.window - 1)).distinct()
    sizes = [shape.window, *sorted(r["n"] for r in short.collect())]  # fewer numbers than a window has words
    keys = item_windows(items_, shape, sizes[0])
    for size in sizes[1:]:
        keys = keys.unionByName(item_windows(items_, shape, size))
    keys = materialise(keys, "keys")
    bits, n_bits = bitmap(keys)
    narrow = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("key"), "text")

    def looked_up(words: Column, size: int) -> Column:
        def rows(h: Column) -> Column:
            index = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
            maybe = F.filter(index, lambda i: F.getbit(F.get(bits, _word(F.get(h, i), n_bits)), _place(F.get(h, i), n_bits)) == 1)
            return F.transform(maybe, lambda i: F.struct(F.pmod(i, (F.size(h) / 2).cast("int")).alias("place"), F.get(h, i).alias("hash")))

        return let(windows(words, size), rows)

    rows = let(word_array(F.col("text")), lambda w: F.concat(*(looked_up(w, size) for size in sizes)))
    found = inline_rows(narrow, ["doc_id", "key"], rows, "hash")
    found = found.join(broadcast_if_small(keys.withColumnRenamed("key", "hash")), "hash")
    hits = found.select("doc_id", "key", "item", "variant", "n", (F.col("place") - F.col("at")).alias("shift")).distinct()
    per_doc = materialise(hits.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "variant", "shift", "n")).alias("hits")), "hits")
    texts = narrow.join(per_doc, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    # only the words under the item travel on, not the whole text
    under = F.transform(
        "hits",
        lambda h: F.struct(h["item"].alias("item"), h["variant"].alias("variant"), h["shift"].alias("shift"), F.slice("w", F.greatest(h["shift"], F.lit(0)) + 1, h["n"]).alias("w")),
    )
    rows = texts.withColumn("w", word_array(F.col("text"))).select("doc_id", "key", F.inline(under))
    sized = items_.withColumn("n_item_words", F.size("words"))
    laid = rows.join(broadcast_if_small(sized), ["item", "variant"])
    for name, column in _agreement(shape).items():
        laid = laid.withColumn(name, column)
    least = F.least(F.lit(shape.run), "n_item_words")
    laid = laid.withColumn("part", _part(F.col("whole")))
    good = (F.col("run") >= least) & (_literal(F.col("part")) * 2 >= F.col("run")) & _one_to_one(_slots(F.col("part")))
    other = F.when((F.col("run") >= least) & ~F.col("good"), longest_consistent(F.col("pairs"), F.greatest(least, F.col("verbatim") + 1)))
    laid = laid.withColumn("good", good).withColumn("chosen", F.when(F.col("good"), F.col("whole")).otherwise(other))
    laid = laid.withColumn("slots", F.when(F.col("chosen").isNotNull(), _slots(_part(F.col("chosen")))))
    changed = F.size(F.filter("slots", lambda p: p["i"] != p["d"]))
    fits = F.col("chosen").isNotNull()
    kept = laid.filter(fits | (F.col("verbatim") >= least)).select(
        "doc_id", "key", "item", "variant", "shift", "n_item_words",
        F.when(fits, F.col("chosen")["run"]).otherwise(F.col("verbatim")).alias("run"),
        F.when(fits, F.size("slots")).otherwise(0).alias("n_slots"),
        F.when(fits, changed).otherwise(0).alias("n_changed"),
    )
    best = F.max_by(F.struct("run", "n_item_words", "n_slots", "n_changed"), F.struct("run", -F.col("variant"), -F.col("shift")))
    return kept.groupBy("doc_id", "key", "item").agg(best.alias("b")).select("doc_id", "key", F.col("item").alias("item_id"), "b.*")
