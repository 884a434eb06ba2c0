"""Weighted medians by histogram descent against sorting."""

from __future__ import annotations

import math
import random

import pytest

from fieldtrace.functions import stats
from fieldtrace.operators import quantiles


@pytest.mark.parametrize("bins", [2, 16, 1024])
def test_equal_to_sorting(spark, bins):
    rng = random.Random(bins)
    kinds = {"a": lambda: rng.gauss(0, 1), "b": lambda: rng.choice([1.0, 2.0]), "c": lambda: 10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), "d": lambda: 7.5, None: lambda: rng.random() * 1e-9 + 1e6}
    rows = [(k, f(), rng.choice([0, 1, 1, 5, -2])) for k, f in kinds.items() for _ in range(301)]
    rows += [("e", None, 3), ("f", 1.0, 0), ("g", 4.0, 2), ("a", math.nan, 90), ("a", None, 90)]
    df = spark.createDataFrame(rows, "k string, v double, w long").repartition(7)
    got = {r.k: r.m for r in quantiles.weighted_median(df, ["k"], "v", "w", "m", bins).collect()}
    want = {r.k: r.m for r in stats.weighted_median(df.where("not isnan(v)"), ["k"], "v", "w", "m").collect()}
    assert got == want and got.keys() == {"a", "b", "c", "d", None, "g"}


def test_a_hot_key_is_counted_before_the_shuffle(spark):
    df = spark.range(200_000).selectExpr("if(id % 2 = 0, 0, id % 50) AS k", "cast(xxhash64(id) % 100000 AS double) AS v", "1 AS w").repartition(8)
    got = {r.k: r.m for r in quantiles.weighted_median(df, ["k"], "v", "w", "m").collect()}
    assert got == {r.k: r.m for r in stats.weighted_median(df, ["k"], "v", "w", "m").collect()}


def test_no_rows(spark):
    assert quantiles.weighted_median(spark.createDataFrame([], "k int, v double, w double"), ["k"], "v", "w").count() == 0
