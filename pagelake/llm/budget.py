"""Mixing sources to target weights by budgets that flow down a tree of domain, language and source.

The token budget is split at the root by the weights of the domains, in each domain by those of its
languages, and in each language by those of its sources. A node cannot take more than its documents
give in ``epochs`` passes; what it cannot take goes to its siblings by their weights, and only what
all of them cannot take either goes back to the parent's siblings. This holds because a parent's
capacity is the sum of its children's, so every level is filled up to its capacities before the next.
One level is solved in closed form: children in the order of capacity per weight are full as long as
their capacity is no more than their share of what is left; from the first that is not, all others
divide the rest. Amounts are whole tokens (a division rounds down, so a level may leave up to a token
per child unspent), computed as decimals of 38 digits: every engine finds the same numbers.

In each leaf whole epochs are taken first; the last one is a seeded order (md5 of seed, epoch, id and
text hash) of which the shortest prefix with enough tokens is taken. The prefix of a leaf of any size
comes from sums per slice of the order (``SLICES`` equal ranges of the hash, summed with a partial
step); only documents of the slice where the budget ends are sorted.

Null domain, language or source is a node of its own, written ''. Null texts have no tokens and are
never taken; a weight that is not listed is 1; a leaf of weight 0 takes nothing. Rows that repeat an
id and text share a place in the order and are taken one by one, as equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.sources.store import broadcast_if_small, materialise

#: Slices of a leaf's order, named by the first three hexadecimal digits of the hash.
SLICES = 4096
_WHOLE = "decimal(38,0)"


class Plan(NamedTuple):
    """Budget in tokens (or a share of all in per cent), passes at most, seed, weights by level.

    ``weights`` has one (level, value, weight) per listed node, weights whole numbers; a value holds for the nodes
    of that level anywhere in the tree. ``levels`` are the columns from the root to the leaf.
    """

    percent: int = 50
    epochs: int = 2
    seed: int = 17
    weights: Sequence[tuple[str, str, int]] = ()
    levels: Sequence[str] = ("domain", "lang", "source")
    tokens: int | None = None


def token_count(text: Column) -> Column:
    """Words of a text, split at ASCII white space."""
    one_blank = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    clean = F.trim(one_blank)
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "))) + 1).cast("long")


def _weight(level: str, plan: Plan) -> Column:
    listed = [(v, w) for name, v, w in plan.weights if name == level]
    if not listed:
        return F.lit(1)
    table = F.create_map(*(F.lit(x) for pair in listed for x in pair))
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(1))


def _divide(children: DataFrame, parent: Sequence[str], level: str) -> DataFrame:
    """Budget of each child from its capacity, its weight and what its parent was given.

    The windows hold the children of one node, which are rows of the aggregated tree, not documents.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity").cast("double") / F.col("weight"), level)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(_WHOLE))
    weights_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast(_WHOLE)
    fits = F.col("capacity") * weights_left <= F.col("weight") * (F.col("given") - before)
    marked = children.filter("weight > 0").withColumn("fits", fits)
    left = F.col("given") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("capacity"))).over(group), F.lit(0).cast(_WHOLE))
    weight = F.sum(F.when(~F.col("fits"), F.col("weight"))).over(group)
    shared = marked.withColumn("left", left.cast(_WHOLE)).withColumn("weight_left", weight.cast(_WHOLE))
    part = F.when(F.col("fits"), F.col("capacity")).otherwise(F.expr("weight * left div weight_left"))
    return shared.withColumn("budget", part.cast(_WHOLE)).drop("fits", "left", "weight_left", "weight", "given")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Budget of each leaf of a table of levels and tokens (one row per leaf)."""
    whole = leaves.withColumn("capacity", (F.col("tokens") * plan.epochs).cast(_WHOLE))
    if plan.tokens is None:
        given = whole.agg(F.expr(f"CAST(coalesce(sum(tokens), 0) AS {_WHOLE}) * {plan.percent} div 100").alias("given"))
    else:
        given = whole.sparkSession.createDataFrame([(plan.tokens,)], "given long")
    above: list[str] = []
    for level in plan.levels:
        nodes = whole.groupBy(*above, level).agg(F.sum("capacity").cast(_WHOLE).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(level, plan).cast(_WHOLE))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))  # one row
        nodes = nodes.withColumn("given", F.col("given").cast(_WHOLE))
        above = [*above, level]
        given = _divide(nodes, above[:-1], level).select(*above, F.col("budget").alias("given"))
    return leaves.join(given, above).withColumnRenamed("given", "budget")


def select_tokens(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, key (xxhash64 of the text), the levels, tokens and copies of the documents taken.

    ``docs`` has doc_id, text and the level columns.
    """
    levels = list(plan.levels)
    narrow = materialise(
        docs.select(
            F.col("doc_id"),
            F.xxhash64("text").alias("key"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels),
            token_count(F.col("text")).alias("tokens"),
        ).filter("tokens > 0"),
        "counted",
    )
    leaves = materialise(narrow.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    budgets = leaf_budgets(leaves, plan).select(
        *levels, F.expr("CAST(budget div tokens AS INT)").alias("passes"), F.expr("CAST(budget % tokens AS LONG)").alias("rest")
    )
    place = F.md5(F.concat_ws("|", F.lit(str(plan.seed)), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    budgets = materialise(budgets, "budgets")
    ordered = narrow.join(broadcast_if_small(budgets), levels).withColumn("place", place).withColumn("slice", F.substring("place", 1, 3))
    sums = ordered.filter("rest > 0").groupBy(*levels, "slice", "rest").agg(F.sum("tokens").alias("held"))
    running = F.sum("held").over(Window.partitionBy(*levels).orderBy("slice")) - F.col("held")
    cuts = materialise(sums.withColumn("before", running).filter("before < rest AND before + held >= rest").select(*levels, F.col("slice").alias("cut"), "before"), "cuts")
    placed = ordered.join(broadcast_if_small(cuts), levels, "left")
    sure = placed.filter("cut IS NULL OR slice <> cut").withColumn("copies", F.col("passes") + F.coalesce((F.col("slice") < F.col("cut")).cast("int"), F.lit(0)))
    prefix = Window.partitionBy(*levels).orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter("slice = cut").withColumn("copies", F.col("passes") + (F.col("before") + F.coalesce(F.sum("tokens").over(prefix), F.lit(0)) < F.col("rest")).cast("int"))
    return sure.unionByName(edge).filter("copies > 0").select("doc_id", "key", *levels, "tokens", "copies")


def oracle(plan: Plan, source: str) -> str:
    """DuckDB SQL of the same selection; ``source`` is SQL for doc_id, text and the level columns."""
    levels = list(plan.levels)
    steps = [f"source AS ({source})"]
    names = ", ".join(levels)
    steps.append(
        f"counted AS (SELECT doc_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in levels)}, "
        "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM source)"
    )
    steps.append(f"leaves AS (SELECT {names}, sum(tokens)::HUGEINT AS tokens FROM counted WHERE tokens > 0 GROUP BY ALL)")
    total = str(plan.tokens) if plan.tokens is not None else f"coalesce(sum(tokens), 0) * {plan.percent} // 100"
    steps.append(f"given0 AS (SELECT ({total})::HUGEINT AS given FROM leaves)")
    for n, level in enumerate(levels):
        above, here = levels[:n], ", ".join(levels[: n + 1])
        listed = [(v, w) for name, v, w in plan.weights if name == level]
        weight = f"CASE {level} {' '.join(f"WHEN '{v}' THEN {w}" for v, w in listed)} ELSE 1 END" if listed else "1"
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        order = f"{part} ORDER BY capacity::DOUBLE / weight, {level}"
        joined = f"JOIN given{n} USING ({', '.join(above)})" if above else f"CROSS JOIN given{n}"
        steps.append(
            f"nodes{n} AS (SELECT {here}, capacity, weight, given FROM (SELECT {here}, sum(tokens)::HUGEINT * {plan.epochs} AS capacity, ({weight})::HUGEINT AS weight "
            f"FROM leaves GROUP BY ALL) {joined} WHERE weight > 0)"
        )
        steps.append(
            f"fitted{n} AS (SELECT *, capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) "
            f"<= weight * (given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fits FROM nodes{n})"
        )
        steps.append(
            f"given{n + 1} AS (SELECT {here}, CASE WHEN fits THEN capacity ELSE weight * (given - coalesce(sum(capacity) FILTER (fits) OVER ({part}), 0)) "
            f"// sum(weight) FILTER (NOT fits) OVER ({part}) END AS given FROM fitted{n})"
        )
    steps.append(
        f"placed AS (SELECT c.*, (g.given // l.tokens)::INT AS passes, g.given % l.tokens AS rest, "
        f"md5(concat('{plan.seed}|', g.given // l.tokens, '|', doc_id)) AS place FROM counted c JOIN leaves l USING ({names}) JOIN given{len(levels)} g USING ({names}) WHERE c.tokens > 0)"
    )
    steps.append(
        f"taken AS (SELECT *, (passes + (coalesce(sum(tokens) OVER (PARTITION BY {names} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest)::INT)::INT AS copies FROM placed)"
    )
    return f"WITH {', '.join(steps)} SELECT doc_id, {names}, tokens, copies FROM taken WHERE copies > 0"
