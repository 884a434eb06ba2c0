"""Passes tracked together against each pass tracked alone."""

from __future__ import annotations

import numpy as np
import pytest

from fieldtrace.operators import kernels

CASES = [
    {"vmax": 1.4, "smooth": 0.025, "mode": "greedy"}, {"vmax": 1.0}, {"vmax": 2.0, "smooth": 0.02, "direction": 1}, {"vmax": 1.4, "direction": -1, "mode": "greedy"},
    {"vmax": 1.4, "speed": True, "speed_weight": 1.0, "smooth": 0.025, "mode": "greedy"}, {"vmax": 1.6, "step": True, "step_sigma": 0.8, "step_weight": 0.5},
    {"vmax": 1.2, "start": True}, {"vmax": 1.4, "lag": 0}, {"vmax": 1.4, "lag": 5, "start": True}, {"vmax": 1.4, "lag": 15},
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("states", [1, 2, 48])
def test_batch_equals_each_pass_alone(case, states):
    rng = np.random.default_rng(case)
    rows = np.array([1, 2, 7, 30, 12, 30, 3])
    obs = rng.integers(0, 4, (7, 30)).astype(float)  # many equal choices
    obs[rng.random(obs.shape) < 0.1] = np.nan
    ref, dist = rng.integers(0, 4, states).astype(float), np.arange(states, dtype=float)
    ll = np.stack([kernels.log_likelihood(o, ref, 1.2) for o in obs])
    kw = dict(CASES[case])
    speed, step, start = np.where(rng.random((7, 30)) < 0.2, np.nan, rng.random((7, 30))), rng.normal(size=(7, 30)), rng.normal(size=(7, states))
    full = kw | {k: v for k, v in (("speed", speed), ("step", step), ("start", start)) if kw.get(k)}
    got = kernels.viterbi_batch(ll, rows, dist, 1.0, **full)
    for i, n in enumerate(rows):
        own = kw | {k: v for k, v in (("speed", speed[i, :n]), ("step", step[i, :n]), ("start", start[i])) if kw.get(k)}
        if (lag := own.pop("lag", None)) is not None:
            assert np.array_equal(got["path"][i, :n], kernels.fixed_lag(ll[i, :n], dist, np.ones(n), own.pop("vmax"), lag, **own))
            continue
        want = kernels.viterbi(ll[i, :n], dist, np.ones(n), own.pop("vmax"), **own)
        assert np.array_equal(got["path"][i, :n], want["path"])
        assert (got["score"][i], got["margin"][i], got["fallback"][i]) == (want["score"], want["margin"], want["fallback"])


@pytest.mark.parametrize("cells", [1, 500, 10**9])
def test_frames_are_cut_between_passes(cells):
    import pandas as pd

    from fieldtrace.operators import localize

    rows = pd.DataFrame({"pass": np.repeat([1, 2, 3, 4, 5, 6], [3, 1, 50, 4, 2, 30]), "idx": 0})
    for size in (1, 7, 20, 200):
        got = list(localize.together((rows.iloc[i : i + size] for i in range(0, len(rows), size)), 10, cells))
        assert np.array_equal(pd.concat(got)["pass"], rows["pass"])
        assert sum(g["pass"].nunique() for g in got) == 6  # no pass is in two


@pytest.mark.parametrize("seed", range(4))
def test_offsets_refined_together_equal_each_alone(seed):
    rng = np.random.default_rng(seed)
    rows, dist = np.array([48, 10, 30, 41, 48]), np.arange(48.0)
    ref = np.cumsum(np.round(rng.normal(size=48), 1))
    c = np.sort(np.stack([rng.permutation(48) for _ in rows]).astype(float), axis=1) + 0.25 * seed
    q = np.stack([np.interp(x + s, dist, ref) for x, s in zip(c, (2, 0, -3, 5, 1), strict=True)]) + rng.normal(size=c.shape) * 0.2 * seed
    got = kernels.iccp_batch(c, q, rows, dist, ref, np.array([2.0, 1.0, -2.0, 4.0, 0.0]), 4.0)
    shifts = np.tile(np.arange(-20.0, 21.0), (len(rows), 1))
    costs = kernels.shift_costs(c, q, rows, shifts, dist, ref, 30)
    for p, n in enumerate(rows):
        assert got[p] == pytest.approx(kernels.iccp(c[p, :n], q[p, :n], dist, ref, [2.0, 1.0, -2.0, 4.0, 0.0][p], 4.0), abs=1e-9)
        assert costs[p] == pytest.approx([kernels.shift_cost(c[p, :n] + o, q[p, :n, None], dist, ref[:, None], 30) for o in shifts[p]], abs=1e-9)


def test_offsets_of_passes_with_missing_values(spark):
    from fieldtrace.operators import localize

    rng = np.random.default_rng(1)
    dist, ref = np.arange(48.0), np.cumsum(rng.normal(size=48))
    rows = [(p, c, None if p == 2 and c == 7 else float(ref[min(47, c + p)])) for p in range(4) for c in range(44)]
    df = spark.createDataFrame(rows, "pass long, cell long, v double")
    got = {(r["case"], r["pass"]): r.offset for r in localize.refine_offsets(df, dist, ref, {"a": (0, 8.0), "b": (6, 4.0)}).collect()}
    assert len(got) == 8
    for (case, p), offset in got.items():
        c, v = np.arange(44.0), np.array([np.nan if r[2] is None else r[2] for r in rows if r[0] == p])
        first = 0.0 if case == "a" else float(min(range(-6, 7), key=lambda o: (kernels.shift_cost(c + o, v[:, None], dist, ref[:, None], 30), o)))
        assert offset == pytest.approx(kernels.iccp(c, v, dist, ref, first, 8.0 if case == "a" else 4.0), abs=1e-9)


@pytest.mark.parametrize("states", [1, 3, 30])
def test_windows_placed_together_equal_each_alone(states):
    rng = np.random.default_rng(states)
    ll = -rng.integers(0, 4, (9, 12, states)).astype(float)  # many equal choices
    state, score = kernels.step_viterbi_batch(ll, 1, 2.0, 3)
    assert [(a, b) for a, b in zip(state, score, strict=True)] == [kernels.step_viterbi(x, 1, 2.0, 3) for x in ll]


@pytest.mark.parametrize("states", [2, 48])
@pytest.mark.parametrize("warmup", [1, 10, 60])
def test_hypotheses_of_many_passes_equal_each_alone(states, warmup):
    rng = np.random.default_rng(warmup)
    rows, dist = np.array([1, 9, 10, 30, 12, 30]), np.arange(states, dtype=float)
    ref = rng.integers(0, 4, states).astype(float)
    ll = np.stack([kernels.log_likelihood(rng.integers(0, 4, 30).astype(float), ref, 1.2) for _ in rows])
    got = kernels.delayed_hypotheses_batch(ll, rows, dist, 1.0, 1.4, warmup, separation=8.0)
    at = 0
    for p, n in enumerate(rows):
        for h in kernels.delayed_hypotheses(ll[p, :n], dist, np.ones(n), 1.4, warmup, separation=8.0):
            assert got["pass"][at] == p and np.array_equal(got["path"][at, :n], h["path"])
            assert all(got[k][at] == pytest.approx(h[k], abs=1e-12) for k in ("score", "mean", "median", "p10", "trim20", "trim35"))
            at += 1
    assert at == len(got["pass"])


@pytest.mark.parametrize("case", [{"switch": 4.0}, {"switch": 1.0, "edge": 0.5, "smooth": 0.025}, {"switch": 8.0, "opposite_start": 4.0}])
@pytest.mark.parametrize("states", [2, 48])
def test_turning_passes_together_equal_each_alone(case, states):
    rng = np.random.default_rng(states)
    rows, dist, ref = np.array([1, 2, 30, 12, 30]), np.arange(states, dtype=float), rng.integers(0, 4, states).astype(float)
    ll = np.stack([kernels.log_likelihood(rng.integers(0, 4, 30).astype(float), ref, 1.2) for _ in rows])
    path, way = kernels.switching_batch(ll, rows, dist, 1.0, 1.4, **case)
    for p, n in enumerate(rows):
        want = kernels.switching_viterbi(ll[p, :n], dist, np.ones(n), 1.4, **case)
        assert np.array_equal(path[p, :n], want[0]) and np.array_equal(way[p, :n], want[1])


def test_best_configurations_and_own_maps(spark):
    from fieldtrace.operators import localize

    rng = np.random.default_rng(5)
    dist, refs = np.arange(20.0), rng.normal(size=(6, 20))
    obs = [(p, i, float(x), float(i % 20)) for p in range(6) for i, x in enumerate(rng.normal(size=5 + 4 * p))]
    df = spark.createDataFrame(obs, "pass long, idx long, obs double, truth double")
    configs = {"a": {"vmax": 1.0}, "b": {"vmax": 2.0, "smooth": 0.3}, "c": {"vmax": 1.0}}  # a and c are equal
    rows = localize.track(df, dist, refs[0], configs).collect()
    best = {}
    for r in rows:
        best[r["pass"]] = max(best.get(r["pass"], (-np.inf, "")), (r.score, r.config))
    want = sorted((r["pass"], r.config, r.idx, r.pred) for r in rows if best[r["pass"]][1] == r.config)
    assert sorted((r["pass"], r.config, r.idx, r.pred) for r in localize.track(df, dist, refs[0], configs, best=True).collect()) == want
    maps = spark.createDataFrame([(p, refs[p].tolist()) for p in range(6)], "pass long, ref array<double>")
    got = {(r["pass"], r.config, r.idx): r.pred for r in localize.track_on_own(df.join(maps, "pass").selectExpr("pass", "idx", "obs", "truth", "CASE WHEN idx = 2 THEN ref END AS ref"), configs).collect()}
    assert len(got) == 3 * len(obs)
    for p in range(6):
        own = np.array([r[2] for r in obs if r[0] == p])
        path = kernels.viterbi(kernels.log_likelihood(own, refs[p], 1.2), dist, np.ones(len(own)), 2.0, smooth=0.3)["path"]
        assert [got[p, "b", i] for i in range(len(own))] == path.tolist()
