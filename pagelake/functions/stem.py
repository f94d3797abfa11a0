"""Porter stemming (M. F. Porter, 1980) as native regular-expression columns.

The measure tests of the paper are regular expressions over the stem, so each step
is a CASE over suffix rules. Run it on distinct terms, then join back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import let

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_HEAD = f"^(?:{_CC}{_VV}|[aeiou]+)"  # through the first vowels; a first y is a consonant
MEASURE_1 = f"{_HEAD}{_CC}"  # m > 0
MEASURE_2 = f"{_HEAD}{_CC}{_VV}{_CC}"  # m > 1
MEASURE_IS_1 = f"{_HEAD}{_CC}(?:{_VV})?$"  # m = 1
HAS_VOWEL = f"^(?:{_CC}{_V}|[aeiou])"
SHORT_END = f"^{_CC}{_V}[^aeiouwxy]$"  # consonant, vowel, consonant but w, x, y

# The suffix tables of steps 2, 3 and 4, longest match first.
STEP_2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"),
    ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("ator", "ate"), ("eli", "e"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
)


def _stem_of(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _first_rule(word: Column, rules: list[tuple[str, Column]]) -> Column:
    """The first rule whose suffix matches decides, as in the paper."""
    out = None
    for suffix, result in rules:
        hit = word.endswith(suffix)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(word)


def _step_1a(w: Column) -> Column:
    return _first_rule(w, [
        ("sses", _stem_of(w, "es")), ("ies", _stem_of(w, "es")), ("ss", w), ("s", _stem_of(w, "s")),
    ])


def _tidy(stem: Column) -> Column:
    double = stem.rlike("(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$")
    return (
        F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(double, _stem_of(stem, "x"))
        .when(stem.rlike(MEASURE_IS_1) & _ends_short(stem), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _ends_short(stem: Column) -> Column:
    """*o of the paper, tested where m = 1 has been tested already."""
    return stem.rlike(SHORT_END)


def _step_1b(w: Column) -> Column:
    def cut(suffix: str) -> Column:
        stem = _stem_of(w, suffix)
        return F.when(stem.rlike(HAS_VOWEL), let(stem, _tidy)).otherwise(w)

    eed = _stem_of(w, "eed")
    return _first_rule(w, [
        ("eed", F.when(eed.rlike(MEASURE_1), _stem_of(w, "d")).otherwise(w)),
        ("ed", cut("ed")), ("ing", cut("ing")),
    ])


def _step_1c(w: Column) -> Column:
    stem = _stem_of(w, "y")
    return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _replace_step(w: Column, table: tuple[tuple[str, str], ...]) -> Column:
    rules = []
    for suffix, new in table:
        stem = _stem_of(w, suffix)
        rules.append((suffix, F.when(stem.rlike(MEASURE_1), F.concat(stem, F.lit(new))).otherwise(w)))
    return _first_rule(w, rules)


def _step_4(w: Column) -> Column:
    rules = []
    for suffix in STEP_4:
        stem = _stem_of(w, suffix)
        ok = stem.rlike(MEASURE_2)
        if suffix == "ion":
            ok = ok & stem.rlike("[st]$")
        rules.append((suffix, F.when(ok, stem).otherwise(w)))
    return _first_rule(w, rules)


def _step_5a(w: Column) -> Column:
    stem = _stem_of(w, "e")
    drop = stem.rlike(MEASURE_2) | (stem.rlike(MEASURE_IS_1) & ~_ends_short(stem))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _step_5b(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_2), _stem_of(w, "l")).otherwise(w)


def porter_stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters stay as they are."""
    out = word
    for step in (
        _step_1a, _step_1b, _step_1c,
        lambda w: _replace_step(w, STEP_2), lambda w: _replace_step(w, STEP_3),
        _step_4, _step_5a, _step_5b,
    ):
        out = let(out, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), out).otherwise(word)
