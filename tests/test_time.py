"""Latencies of any weight and analyses that are limited in time, against plain folds."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagelake.config import DEFAULT
from pagelake.operators.stats import smoothed_latency
from pagelake.operators.upsert import once_per_key


@pytest.mark.parametrize("weight,chunk", [(0.9, 7), (0.9, 100_000), (0.3, 5), (0.3, 100_000), (0.001, 3), (0.001, 50), (1.0, 10)])
def test_latency_equals_a_fold_over_all_history(spark, weight, chunk):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 2, 3]), 1000.0 if i < 3 else r.choice([0.0, r.random()])) for i in range(900)]
    log = spark.createDataFrame(rows, "i long, g int, x double")
    got = {x.i: x.smoothed for x in smoothed_latency(log, "g", ["i"], "x", replace(DEFAULT, latency_weight=weight), chunk).collect()}
    state = {}
    for i, g, x in rows:
        state[g] = weight * x + (1 - weight) * state.get(g, 0.0)
        assert got[i] == pytest.approx(state[g], rel=1e-9, abs=1e-12)
    assert len(got) == len(rows)


def test_one_analysis_per_key_and_time_limit(spark):
    r = random.Random(3)
    rows = [(k, t) for k in "abc" for t in sorted(r.sample(range(0, 200_000), 150))] + [("d", 0), ("d", 0), ("d", 3600), ("d", 3601), ("d", 7201), ("d", 7202)]
    df = spark.createDataFrame(rows, "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = sorted((x.k, x.s) for x in once_per_key(df, "k", "at", 3600).select("k", "s").collect())
    want, last = [], {}
    for k, t in rows:
        if k not in last or t - last[k] > 3600:
            want.append((k, t))
            last[k] = t
    assert got == sorted(want)


def test_analyses_hold_no_key_in_one_row(spark):
    """No aggregation gathers the times of a key; a third of all rows may have one key."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("at"))
    once = once_per_key(rows, "k", "at", 3600)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    assert once.filter("k = -1").count() == -(-20_000 // 172) and once.count() == 40_000 + -(-20_000 // 172)
