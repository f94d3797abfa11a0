"""Column expressions: Column in, Column out, no jobs started."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used inside a lambda of a higher-order function is re-evaluated for
    each element if the optimizer inlines it; binding it as a lambda variable
    keeps one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_alternation(words: tuple[str, ...] | list[str]) -> str:
    """Regex matching any of the words literally, in both Java and RE2 syntax."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\/])", r"\\\1", w) for w in words)


def explode_rows(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per non-null array element.

    The plain generators make the optimizer add a "size > 0" filter, which it then
    pushes down as a second evaluation of a computed array. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def inline_rows(df: DataFrame, keep: list, array: Column, required: str) -> DataFrame:
    """One row per struct of the array; ``required`` names a field that is never null."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(required).isNotNull())


def half_up(value: Column, digits: int = 6) -> Column:
    """Round by floor(x * 10^d + 0.5) / 10^d, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
