"""Near and alike windows: exact against brute force, bands by their recall."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import windowpairs


def data(seed: int, passes: int = 14, starts: int = 40, n: int = 16):
    rng = np.random.default_rng(seed)
    base = np.cumsum(rng.normal(size=starts + n))
    rows = []
    for k in range(passes):
        x = base + rng.normal(size=starts + n) * rng.choice([0.1, 0.5, 3.0])
        for s in range(-5, starts - 5):
            w = x[s + 5 : s + 5 + n]
            rows.append((k, s, ((w - w.mean()) / w.std()).tolist()))
    return rows


def brute(rows, radius, least):
    return {(a, s, b, t): np.dot(x, y) / len(x) for a, s, x in rows for b, t, y in rows if a < b and abs(s - t) <= radius and np.dot(x, y) / len(x) >= least}


@pytest.mark.parametrize(("radius", "group"), [(0, 1024), (2, 1024), (3, 20), (9, 64)])
def test_exact_equals_brute_force(spark, radius, group):
    rows = data(radius)
    df = spark.createDataFrame(rows, "pass long, start long, w array<double>")
    got = windowpairs.alike_windows(df, "pass", radius, 0.8, group=group).collect()
    want = brute(rows, radius, 0.8)
    assert len(got) == len(want) > 0
    assert {(r.a, r.a_start, r.b, r.b_start): r.similarity for r in got} == pytest.approx(want)


def test_bands_find_most_pairs_and_no_others(spark):
    rows = data(5)
    df = spark.createDataFrame(rows, "pass long, start long, w array<double>")
    got = {(r.a, r.a_start, r.b, r.b_start) for r in windowpairs.alike_windows(df, "pass", 3, 0.9, mode="bands").collect()}
    want = set(brute(rows, 3, 0.9))
    print(f"recall of bands: {len(got & want) / len(want):.3f} of {len(want)} pairs, at the threshold {windowpairs.expected_recall(0.9):.3f} expected")
    assert got <= want and len(got) >= 0.9 * len(want)


def test_no_windows(spark):
    none = spark.createDataFrame([], "pass long, start long, w array<double>")
    assert windowpairs.alike_windows(none, "pass", 3, 0.9).count() == 0
    assert windowpairs.alike_windows(none, "pass", 3, 0.9, mode="bands").count() == 0
    assert windowpairs.alike_windows(none.where(F.lit(True)), "pass", 0, 0.5).count() == 0


def test_blocks_of_windows_meet_without_copies(spark):
    df = spark.createDataFrame(data(8), "pass long, start long, w array<double>")
    pairs = windowpairs.alike_windows(df, "pass", 2, 0.8, group=40)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # a window is in one block, and not dealt to each that it meets


@pytest.mark.parametrize("size", [0, 5, 8, 4099])
def test_places_of_hits(size):
    hit = np.random.default_rng(size).random(size) < 0.02
    assert windowpairs._places(hit).tolist() == np.flatnonzero(hit).tolist()
