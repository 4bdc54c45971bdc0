"""The as-of join against a plain search, with hot keys, ties, nulls and empty sides."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.functions.asof import asof_join

T0 = dt.datetime(2024, 1, 1)
L = "id long, key string, ts timestamp_ntz"
R = "key string, at timestamp_ntz, v int, w string"


def rows(seed, n_left, n_right):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 4 + ["a", "b", "c", None])
    when = lambda: None if rng.random() < 0.03 else T0 + dt.timedelta(hours=rng.randrange(60))
    return ([(i, key(), when()) for i in range(n_left)],
            [(key(), when(), None if rng.random() < 0.1 else rng.randrange(50), rng.choice("xyz")) for _ in range(n_right)])


def plain(left, right):
    out = []
    for i, k, t in left:
        own = [r for r in right if r[0] == k and k is not None and r[1] is not None and t is not None and r[1] <= t]
        best = max(own, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3])) if own else (None,) * 4
        out.append((i, k, t, *best[1:]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_left,n_right", [(400, 300), (50, 3), (300, 0), (0, 40)])
def test_asof_against_plain_search(spark, n_left, n_right):
    left, right = rows(n_left, n_left, n_right)
    got = asof_join(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["key"], "ts", "at", ["v", "w"])
    assert got.columns == ["id", "key", "ts", "at", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(left, right)


def test_a_hot_key_spans_many_parts(spark):
    """Every key in one: the match of a part's first rows comes from the parts before it."""
    left = spark.range(4000).select("id", F.lit("k").alias("key"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(T0)).cast("timestamp_ntz").alias("ts"))
    right = spark.createDataFrame([("k", T0, 1, "first")], R)
    got = asof_join(left, right, ["key"], "ts", "at", ["w"])
    assert got.filter("w = 'first'").count() == 4000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan
