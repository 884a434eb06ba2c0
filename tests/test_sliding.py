"""Sliding products, window scores and laid correlations against brute force, for short kernels and by FFT."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import matching, sliding


@pytest.mark.parametrize(("n", "m"), [(5, 5), (4, 5), (40, 7), (900, 64), (900, 65), (5000, 300), (70, 66), (3000, 2900)])
def test_products(n, m):
    rng = np.random.default_rng(n + m)
    values, kernels = rng.normal(size=n), rng.normal(size=(3, m))
    got = sliding.products(values, kernels)
    assert got.shape == (3, max(0, n - m + 1))
    for k in range(3):
        for s in range(got.shape[1]):
            assert got[k, s] == pytest.approx(float(kernels[k] @ values[s : s + m]), abs=1e-9)


@pytest.mark.parametrize(("n", "share"), [(16, 1.0), (16, 0.6), (100, 0.8)])
def test_window_scores(n, share):
    rng = np.random.default_rng(2)
    ref, query = rng.normal(size=400) * 5 + 1000, rng.normal(size=150) + 50
    ref[rng.random(400) < 0.1], query[rng.random(150) < 0.1] = np.nan, np.nan
    ref[50:180] = 7.0  # flat
    r, q = sliding.Windows(ref, n, share), sliding.Windows(query, n, share)

    def window(values, s):
        w = values[s : s + n]
        there = np.isfinite(w)
        if len(w) < n or not there[0] or there.sum() < share * n or np.nanstd(w) < 1e-9:
            return None
        return np.where(there, (w - np.nanmean(w)) / np.nanstd(w), 0.0)

    starts = np.flatnonzero(q.good)
    assert starts.tolist() == [s for s in range(150) if window(query, s) is not None]
    assert np.flatnonzero(r.good).tolist() == [s for s in range(400) if window(ref, s) is not None]
    for mode, of in (("ncc", lambda a, b: a @ b / n), ("msd", lambda a, b: -((a - b) ** 2).mean())):
        got = r.scores(q.at(starts), mode)
        for i, s in enumerate(starts[:20]):
            for p in np.flatnonzero(r.good):
                assert got[i, p] == pytest.approx(of(window(query, s), window(ref, p)), abs=1e-7)


@pytest.mark.parametrize("direction", [1, -1])
@pytest.mark.parametrize("length", [21, 90])
def test_laid_correlations(direction, length):
    rng = np.random.default_rng(5)
    ref, q = rng.normal(size=300) + 400, rng.normal(size=length)
    ref[[40, 41, 200]], q[3] = np.nan, np.nan
    for scale in (0.5, 0.73, 1.0, 1.6):
        places = direction * scale * np.arange(length, dtype=np.float64)
        starts = np.arange(-20, 300, 3)
        got = sliding.laid_correlations(ref, q, places, starts, least=10)
        for s, x in zip(starts, got, strict=True):
            pairs = []
            for y, p in zip(q, s + places, strict=True):
                i = int(np.floor(p))
                if np.isnan(y) or p < 0 or p > len(ref) - 1:
                    continue
                v = ref[i] if p == i else ref[i] + (ref[i + 1] - ref[i]) * (p - i)
                if not np.isnan(v):
                    pairs.append((y, v))
            a = np.array(pairs).reshape(-1, 2)
            if len(a) < 10:
                assert np.isnan(x)
            else:
                assert x == pytest.approx(np.corrcoef(a[:, 0], a[:, 1])[0, 1], abs=1e-8)


def test_flat_sides_have_no_correlation():
    ref, q = np.full(50, 3.3), np.arange(9.0)
    assert np.isnan(sliding.laid_correlations(ref, q, np.arange(9.0), np.arange(40), 3)).all()
    assert np.isnan(sliding.laid_correlations(np.arange(50.0), np.full(9, 0.1), np.arange(9.0), np.arange(40), 3)).all()


def test_a_map_of_a_million_cells(spark):
    n = 1_000_000
    ref = spark.range(n).select(F.lit("v").alias("f"), F.col("id").alias("cell"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    query = ref.where("cell between 700000 and 700299").select(F.lit(1).alias("pass"), "f", (F.col("cell") - 700_000).alias("cell"), "v")
    began = time.time()
    got = matching.window_scores(query, ref, ["pass"], 200, 100, {"scores": (["v"], "ncc")})
    best = {r.start: (r.pred, round(r.best, 6)) for r in matching.best_of(got, ["pass", "start"], 50).collect()}
    assert best == {0: (700_000, 1.0), 100: (700_100, 1.0)} and time.time() - began < 60


def test_what_is_too_large_is_refused_before_it_is_gathered(spark):
    with pytest.raises(Exception, match="too large"):
        matching.checked(spark.range(100), F.lit(50), 4000, "map").collect()
    assert matching.checked(spark.range(80), F.lit(50), 4000, "map").count() == 80
    one = matching.one_row(spark.createDataFrame([(2, [1.0]), (1, [2.0, 3.0])], "s int, w array<double>"), "r", "s", "w").first().r
    assert [(x.s, x.w) for x in one] == [(1, [2.0, 3.0]), (2, [1.0])]
