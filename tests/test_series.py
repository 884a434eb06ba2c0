"""Series in blocks against brute force, whatever the size of the blocks."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import windows
from fieldtrace.operators import series

ROWS = "k string, x long, tie long, v double"


def case(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for k, n in (("long", 300), ("short", 7), ("one", 1), ("empty", 12), (None, 40)):
        x = 0
        for i in range(n):
            x += rng.choice([0, 1, 1, 2, 400 if rng.random() < 0.02 else 1])
            out.append((k, x, i, None if k == "empty" or rng.random() < 0.6 else float(rng.randint(-9, 9))))
    rng.shuffle(out)
    return out


def brute(rows: list[tuple], limit: float) -> dict:
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((x, t, v) for q, x, t, v in rows if q == k)
        for i, (x, t, v) in enumerate(own):
            before = next(((a, b) for a, _, b in reversed(own[: i + 1]) if b is not None), None)
            after = next(((a, b) for a, _, b in own[i:] if b is not None), None)
            if before and after:
                line = before[1] if before[0] == after[0] else before[1] + (after[1] - before[1]) * (x - before[0]) / (after[0] - before[0])
            else:
                line = (before or after or (None, None))[1]
            line = v if v is not None else line
            gaps = [abs(x - p[0]) for p in (before, after) if p]
            out[k, t] = (line, line if gaps and min(gaps) <= limit else None, (before or after or (None, None))[1])
    return out


@pytest.mark.parametrize("rows", [8, 50, 10_000])
def test_fills_equal_brute_force(spark, rows):
    data = case(1)
    df = spark.createDataFrame(data, ROWS).repartition(5)
    fills = {"line": ("v", "linear", None), "near": ("v", "linear", 2.0), "held": ("v", "hold", None)}
    got = {(r.k, r.tie): (r.line, r.near, r.held) for r in series.fill(df, ["k"], "x", fills, ["tie"], rows).collect()}
    want = brute(data, 2.0)
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(w) for key, w in want.items() for g in [got[key]])


def test_blocks_are_even_and_follow_the_data(spark):
    df = spark.range(10_000).select(F.lit("a").alias("k"), F.when(F.col("id") < 9000, F.col("id")).otherwise(F.col("id") * 50).alias("x"))
    sizes = series.cut_blocks(df, ["k"], "x", 500).groupBy("_block").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_block").collect()
    assert len(sizes) > 3 and sum(r.n for r in sizes) == 10_000
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))


def test_asof_in_blocks_equals_asof_in_windows(spark):
    rng = random.Random(4)
    rows = [(k, x, float(rng.randint(0, 50)), rng.random() < 0.4) for k in ("a", "b") for x in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, x long, v double, q boolean")
    for clamp in (True, False):
        want = {(r.k, r.x): r.v for r in windows.asof_linear(df, "k", "x", ["v"], "q", clamp).collect()}
        got = {(r.k, r.x): r.v for r in series.asof_linear(df, ["k"], "x", ["v"], "q", clamp, rows=20).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("rows", [1, 30, 10_000])
def test_rolling_medians_equal_brute_force(spark, rows):
    rng = random.Random(2)
    data = [(k, i, None if rng.random() < 0.3 else float(rng.randint(-20, 20)), p) for k, n, p in (("a", 130, 9), ("b", 4, 21), (None, 33, 3), ("c", 1, 5)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i long, v double, p int").repartition(4)
    got = series.rolling_median(df, ["k"], "i", {"five": ("v", 4, 3), "own": ("v", F.col("p"), F.lit(1))}, rows)
    seen = {(r.k, r.i): (r.five, r.own) for r in got.collect()}
    assert len(seen) == len(data)
    for k, i, _, p in data:
        for at, points, least in ((0, 5, 3), (1, p, 1)):
            near = [v for q, j, v, _ in data if q == k and abs(i - j) <= points // 2 and v is not None]
            want = float(np.median(near)) if len(near) >= least else None
            assert seen[k, i][at] == want


def test_a_pass_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 7 < 3, (F.xxhash64("id") % 100).cast("double")).alias("v"))
    filled = series.fill(df, ["k"], "i", {"f": ("v", "linear", None)})
    began = time.time()
    assert filled.where("f is null").count() == 0
    took = time.time() - began
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    assert series.rolling_median(df, ["k"], "i", {"m": ("v", 501, 10)}).where("m is null").count() == 0
    assert took < 30  # about 5 s on eight cores; one window over the whole pass would not end


def test_empty_series(spark):
    none = spark.createDataFrame([], ROWS)
    assert series.fill(none, ["k"], "x", {"f": ("v", "linear", None)}).count() == 0
    assert series.rolling_median(none, ["k"], "x", {"m": ("v", 5, 3)}).count() == 0
