"""The bounded warping search against warping every place."""

from __future__ import annotations

import numpy as np
import pytest

from fieldtrace.operators import kernels, localize, warping


@pytest.mark.parametrize("r", [0, 1, 3, 50])
def test_sliding_extremes(r):
    v = np.random.default_rng(r).normal(size=37)
    low, high = warping.sliding_extremes(v, r)
    for i in range(37):
        near = v[max(0, i - r) : i + r + 1]
        assert low[i] == near.min() and high[i] == near.max()


@pytest.mark.parametrize("band", [0.02, 0.08, 0.3, 1.0])
@pytest.mark.parametrize("stride", [1, 3])
def test_search_equals_warping_every_place(band, stride):
    rng = np.random.default_rng(int(100 * band) + stride)
    spared = []
    for n, size in ((1, 9), (2, 30), (16, 48), (25, 400), (40, 40)):
        ref = np.cumsum(rng.normal(size=size))
        ref[: size // 3] = np.round(ref[: size // 3])  # ties
        search = warping.WarpSearch(ref, n, stride, band)
        for _ in range(8):
            s = rng.integers(0, size - n + 1)
            w = ref[s : s + n] + rng.normal(size=n) * rng.choice([0.0, 0.1, 2.0])
            tries = [(kernels.dtw_distance(w, ref[k : k + n], band), k) for k in range(0, size - n + 1, stride)]
            distance, place, warped = search.best(w)
            assert (pytest.approx(min(tries)[0], abs=1e-12), min(tries)[1]) == (distance, place)
            spared.append(1 - warped / len(tries))
    print(f"places spared: {np.mean(spared):.2f}")


def test_most_places_of_a_long_map_are_spared():
    rng = np.random.default_rng(1)
    ref = np.cumsum(rng.normal(size=20_000))
    search = warping.WarpSearch(ref, 60)
    shares = []
    for s in rng.integers(0, 19_000, 10):
        distance, place, warped = search.best(ref[s : s + 60] + rng.normal(size=60) * 0.2)
        assert abs(place - s) <= 3 and distance < 0.2
        shares.append(1 - warped / len(search.starts))
    print(f"places spared: {np.mean(shares):.3f}")
    assert np.mean(shares) > 0.9


def test_a_window_longer_than_the_map_has_no_place(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [1.0])], "pass long, start long, w array<double>")
    got = {r.start: r.pred for r in localize.dtw_search(rows, np.arange(2.0), np.array([5.0, 1.0])).collect()}
    assert got[0] is None and got[1] == 1.0


# ---- paths
@pytest.mark.parametrize("segment", [1, 7, 512])
@pytest.mark.parametrize("open_ends", [True, False])
def test_wavefront_paths_equal_row_by_row_paths(segment, open_ends):
    rng = np.random.default_rng(segment + open_ends)
    for n, m in ((1, 1), (1, 6), (6, 1), (9, 14), (20, 12), (33, 40)):
        q, ref = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=m), 1)  # with ties
        qs, rs = np.sort(rng.uniform(0, 20, n)), np.sort(rng.uniform(0, 20, m))
        cost = (q[:, None] - ref[None, :]) ** 2
        for band in (np.inf, 6.0, 1.0):
            allowed = None if np.isinf(band) else np.abs(qs[:, None] - rs[None, :]) <= band
            want, path = kernels.warp_path(cost, allowed, open_ends)
            total, got = warping.warp_path(q, ref, qs, rs, band, open_ends, segment)
            assert total == want and got.tolist() == path.tolist()


def brute_reference(rows: list[tuple], rounds: int, band: float, accept: tuple | None) -> dict[int, float]:
    def median_by(pairs):
        by = {}
        for k, v in pairs:
            by.setdefault(k, []).append(v)
        return {k: float(np.median(v)) for k, v in by.items()}

    passes = {}
    for p, c, v in rows:
        passes.setdefault(p, []).append((c, v))
    base = median_by((c, v) for _, c, v in rows)
    for _ in range(rounds):
        dist = np.array(sorted(base), dtype=float)
        ref = np.array([base[int(c)] for c in dist])
        laid = []
        for own in passes.values():
            own = sorted(own)
            cells, values = (np.array(x, dtype=float) for x in zip(*own, strict=True))
            _, at = kernels.banded_warp(cells, values, dist, ref, band)
            mapped = np.fmax.accumulate(np.where(at >= 0, dist[np.clip(at, 0, len(dist) - 1)], np.nan))
            if accept:
                met = [(v, base[int(m)]) for v, m in zip(values, mapped, strict=True) if not np.isnan(m)]
                a = np.array(met).reshape(-1, 2)
                flat = len(a) < 2 or a[:, 0].std() == 0 or a[:, 1].std() == 0
                shift = np.abs(mapped - cells)[~np.isnan(mapped)]
                if flat or np.corrcoef(a.T)[0, 1] < accept[0] or np.percentile(shift, 90) > accept[1]:
                    mapped = cells
            new = [int(c if np.isnan(m) else m) for c, m in zip(cells, mapped, strict=True)]
            laid += list(median_by(zip(new, values, strict=True)).items())
        base = median_by(laid)
    return base


@pytest.mark.parametrize("accept", [None, (0.5, 3.0)])
def test_aligned_reference_equals_brute_force(spark, accept):
    rng = np.random.default_rng(8)
    base = np.cumsum(rng.normal(size=40))
    rows = [(p, c, float(base[min(39, max(0, c + s))] + rng.normal() * (0.2 if p % 3 else 5))) for p in range(9) for s in [int(rng.integers(-3, 4))] for c in range(2, 38)]
    df = spark.createDataFrame(rows, "pass long, cell long, v double")
    got = {r.cell: r.v for r in localize.aligned_reference(df, rounds=2, band=5.0, accept=accept).collect()}
    assert got == pytest.approx(brute_reference(rows, 2, 5.0, accept))


def test_warps_of_passes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    ref = np.cumsum(rng.normal(size=30))
    rows = [(p, c, float(ref[c] + rng.normal())) for p in range(4) for c in range(p, 30 - p)]
    got = {(r["pass"], r.cell): (r.mapped, r.cost) for r in localize.warp(spark.createDataFrame(rows, "pass long, cell long, v double"), np.arange(30.0), ref, 4.0).collect()}
    for p in range(4):
        own = [(c, v) for q, c, v in rows if q == p]
        cells, values = (np.array(x, dtype=float) for x in zip(*own, strict=True))
        cost, at = kernels.banded_warp(cells, values, np.arange(30.0), ref, 4.0)
        assert {(p, int(c)): got[p, int(c)] for c in cells} == {(p, int(c)): (float(j), pytest.approx(cost)) for c, j in zip(cells, at, strict=True)}


def test_a_long_pair_warps_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    ref = np.cumsum(rng.normal(size=3000))
    q = np.repeat(ref[200:1700], 2)[:2500]
    tracemalloc.start()
    total, path = warping.warp_path(q, ref, segment=64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 0.0 and path[0] >= 200 and peak < 8 * 2500 * 3000 / 4  # a quarter of one matrix of costs


@pytest.mark.parametrize("moves", [1, 2_000, warping.MOVES])
@pytest.mark.parametrize("open_ends", [True, False])
def test_pairs_warped_together_equal_each_alone(moves, open_ends):
    rng = np.random.default_rng(moves + open_ends)
    for m in (1, 6, 14, 40):
        rows = np.array([1, 7, 20, 20, 3, 33])
        q, qs = np.round(rng.normal(size=(6, 33)), 1), np.sort(rng.uniform(0, 20, (6, 33)), axis=1)  # with ties
        q[3, 5] = np.nan
        ref, rs = np.round(rng.normal(size=m), 1), np.sort(rng.uniform(0, 20, m))
        for band in (np.inf, 6.0, 1.0):
            total, got = warping.warp_paths(q, rows, ref, qs, rs, band, open_ends, moves)
            for p, n in enumerate(rows):
                want, path = warping.warp_path(q[p, :n], ref, qs[p, :n], rs, band, open_ends)
                assert (total[p] == want or np.isnan(want)) and got[p, :n].tolist() == path.tolist() and (got[p, n:] == -1).all()


def test_windows_searched_together_equal_each_alone():
    rng = np.random.default_rng(2)
    ref = np.cumsum(rng.normal(size=150))
    search = warping.WarpSearch(ref, 16, 1, 0.2)
    windows = np.stack([ref[a : a + 16] + rng.normal(size=16) * s for a in (0, 7, 60, 134) for s in (0.0, 0.3, 3.0)])
    distance, place, warped = search.best_of(windows)
    for i, w in enumerate(windows):
        costs = [kernels.dtw_distance(w, ref[a : a + 16], 0.2) for a in range(135)]
        assert place[i] == int(np.argmin(costs)) and distance[i] == pytest.approx(min(costs))
        assert (distance[i], place[i], warped[i]) == search.best(w)
    assert warped.max() < 135
