"""Kernels against enumeration and independent formulas."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtrace.operators import kernels


def brute_path(ll, dist, reach, smooth):
    best, paths = -np.inf, None
    for p in product(range(len(dist)), repeat=len(ll)):
        if all(abs(a - b) <= reach for a, b in zip(p, p[1:], strict=False)):
            score = sum(ll[t, s] for t, s in enumerate(p)) - smooth * sum((a - b) ** 2 for a, b in zip(p, p[1:], strict=False))
            if score > best + 1e-12:
                best, paths = score, p
    return best, paths


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_exact_viterbi_is_the_enumerated_optimum(seed):
    ll = np.random.default_rng(seed).normal(size=(5, 4))
    got = kernels.viterbi(ll, np.arange(4.0), np.ones(5), 1.0, smooth=0.7)
    score, path = brute_path(ll, np.arange(4), 1, 0.7)
    assert got["score"] == pytest.approx(score)
    assert tuple(got["path"]) == path


def test_greedy_differs_from_exact_and_never_beats_it():
    differ = 0
    for seed in range(60):
        ll = np.random.default_rng(seed).normal(size=(6, 5))
        exact, greedy = (kernels.viterbi(ll, np.arange(5.0), np.ones(6), 2.0, smooth=1.0, mode=m) for m in ("exact", "greedy"))
        assert greedy["score"] <= exact["score"] + 1e-9
        differ += greedy["score"] < exact["score"] - 1e-9
    assert differ


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, -1]))
def test_paths_keep_the_speed_bound_and_direction(seed, direction):
    ll = np.random.default_rng(seed).normal(size=(12, 9))
    path = kernels.viterbi(ll, np.arange(9.0), np.ones(12), 2.0, direction=direction)["path"]
    step = np.diff(path)
    assert np.abs(step).max() <= 2
    assert direction == 0 or (step * direction >= 0).all()


def test_fixed_lag_with_the_whole_pass_is_the_full_path():
    ll = np.random.default_rng(4).normal(size=(15, 7))
    full = kernels.viterbi(ll, np.arange(7.0), np.ones(15), 1.0)["path"]
    assert (kernels.fixed_lag(ll, np.arange(7.0), np.ones(15), 1.0, 20) == full).all()
    first = kernels.fixed_lag(ll, np.arange(7.0), np.ones(15), 1.0, 0)
    for t in range(15):
        assert first[t] == kernels.viterbi(ll[: t + 1], np.arange(7.0), np.ones(15), 1.0)["path"][-1]


def test_warps():
    a = np.sin(np.arange(30) / 3)
    assert kernels.dtw_distance(a, a) == 0
    cost, path = kernels.warp_path((a[5:20, None] - a[None, :]) ** 2)
    assert cost == pytest.approx(0) and (path == np.arange(5, 20)).all()
    total, none = kernels.banded_warp(np.array([100.0]), np.array([1.0]), np.arange(5.0), np.zeros(5), band=2)
    assert np.isinf(total) and (none == -1).all()


def test_warp_cost_against_recursion():
    rng = np.random.default_rng(1)
    c = rng.random((5, 6))

    def least(i, j):
        if i == 0:
            return c[0, j]
        return c[i, j] + min([least(i - 1, j), *([least(i, j - 1), least(i - 1, j - 1)] if j else [])])

    # row 0 is open: moving along it is never cheaper than starting later
    assert kernels.warp_path(c)[0] == pytest.approx(min(least(4, j) for j in range(6)))


def test_refinement_finds_a_shift():
    pos = np.arange(0, 100, 0.5)
    field = np.sin(pos / 4) + pos / 50
    q = np.arange(20, 60, 0.5)
    got = kernels.iccp(q, np.interp(q + 3.0, pos, field), pos, field, 2.5)
    assert got == pytest.approx(3.0, abs=0.11)


def test_pose_graph_pulls_drift_back():
    truth = np.arange(20.0)
    odometry = truth * 1.1
    off = lambda x: np.abs(x - truth).max()
    assert off(kernels.pose_graph(odometry, [(0, 19, 19.0), (3, 12, 9.0)], 0.5, 0.1)) < off(odometry) / 2
    loops = [(0, 19, 19.0), (3, 12, 9.0), (2, 15, 60.0)]  # the last one is wrong; weights limit its pull
    assert off(kernels.pose_graph(odometry, loops, 0.5, 0.1)) < off(kernels.pose_graph(odometry, loops, 0.5, 0.1, robust=False))


def test_particle_filter_repeats_with_its_seed():
    ll = kernels.log_likelihood(np.arange(40) / 10, np.arange(40) / 10, 0.2)
    a, b = (kernels.particle_filter(ll, np.arange(40.0), np.ones(40), 2.0, seed=3) for _ in range(2))
    assert (a == b).all() and abs(a[-1] - 39) < 6


def test_sequence_scores_peak_at_the_true_state():
    dist = np.arange(60.0)
    ref = np.sin(dist / 4) + 0.3 * np.cos(dist / 1.7)
    window = ref[20:36]
    s = kernels.sequence_scores(window, np.arange(16.0), ref, dist, 1)
    assert int(np.nanargmax(s)) == 35


def test_separated_top_and_gate():
    score, dist = np.array([1.0, 5.0, 5.0, 4.0, 0.0]), np.arange(5.0)
    assert kernels.separated_top(score, dist, 3, 2) == [1, 3]
    ll = np.array([[0.0, -1.0, -0.1, -3.0]])
    assert kernels.uniqueness_gate(ll, np.arange(4.0), 1, 0.3, 0.0, 0.2)[0] == pytest.approx(ll[0] * 0.5)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_window_steps_are_the_enumerated_optimum(seed):
    ll = np.random.default_rng(seed).normal(size=(4, 6))
    state, score = kernels.step_viterbi(ll, 1, 0.8, 2)
    prior = lambda p: sum(-0.5 * ((b - a - 1) / 0.8) ** 2 for a, b in zip(p, p[1:], strict=False))
    paths = [p for p in product(range(6), repeat=4) if all(abs(b - a - 1) <= 2 for a, b in zip(p, p[1:], strict=False))]
    best = max(paths, key=lambda p: sum(ll[t, s] for t, s in enumerate(p)) + prior(p))
    assert state == best[0] and score == pytest.approx((sum(ll[t, s] for t, s in enumerate(best)) + prior(best)) / 4)


def test_moves_round_the_speed_bound_up():
    assert [kernels.reach_of(v, 1.0, 0.5) for v in (0.1, 0.5, 1.2, 1.4, 1.5)] == [1, 1, 3, 3, 3]


def test_edges_cost_dwelling_near_them_alone():
    dist, ll = np.arange(30.0), np.zeros((6, 30))
    ll[:, 1] = 1.0
    near, _ = kernels.switching_viterbi(ll, dist, np.ones(6), 1.0, 5.0, edge=3.0, edge_m=5.0)
    free, _ = kernels.switching_viterbi(ll, dist, np.ones(6), 1.0, 5.0)
    assert (free == 1).all() and not (near == 1).all()


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_pose_graph_is_the_dense_solution(seed):
    rng = np.random.default_rng(seed)
    n = 25
    odom = np.cumsum(rng.normal(1, 0.3, n))
    loops = [(int(i), int(j), float(rng.normal(0, 1))) for i, j in rng.integers(0, n, (6, 2)) if i != j]
    got = kernels.pose_graph(odom, loops, 0.5, 1.0, robust=False)
    rows, goal = [], []
    for k in range(n - 1):
        row = np.zeros(n)
        row[[k, k + 1]] = -1 / 0.5, 1 / 0.5
        rows.append(row), goal.append((odom[k + 1] - odom[k]) / 0.5)
    for i, j, z in loops:
        row = np.zeros(n)
        row[j] += 1.0
        row[i] -= 1.0
        rows.append(row), goal.append(z)
    a, b = np.array(rows), np.array(goal) - np.array(rows)[:, 0] * odom[0]
    want = np.linalg.lstsq(a[:, 1:], b, rcond=None)[0]
    assert got[0] == odom[0] and np.allclose(got[1:], want, atol=1e-6)


def test_sequence_scores_are_correlations_behind_each_state():
    rng = np.random.default_rng(5)
    dist, ref = np.arange(40.0), rng.normal(size=40)
    travelled = np.cumsum(rng.uniform(0.2, 1.2, 15))
    values = np.where(rng.random(15) < 0.2, np.nan, rng.normal(size=15))
    for way in (1, -1):
        got = kernels.sequence_scores(values, travelled, ref, dist, way)
        for s, end in enumerate(dist):
            at = end - way * (travelled[-1] - travelled)
            ok = (at >= 0) & (at <= 39) & np.isfinite(values)
            if ok.sum() < 8:
                assert np.isnan(got[s])
            else:
                assert got[s] == pytest.approx(np.corrcoef(values[ok], np.interp(at[ok], dist, ref))[0, 1])


def test_pieces_and_suffix_turn_where_told():
    ll, dist = np.random.default_rng(7).normal(size=(20, 15)), np.arange(15.0)
    path = kernels.piecewise_path(ll, dist, np.ones(20), 1.0, 12)
    assert (np.diff(path[:12]) >= 0).all() and (np.diff(path[12:]) <= 0).all()
    step = np.full(20, -1.0)
    path = kernels.suffix_path(np.zeros((20, 15)), dist, np.ones(20), 1.0, 6, step=step, step_sigma=0.2, step_weight=10.0)
    assert (np.diff(path[6:15]) <= 0).all() and path[14] < path[6] or path[6] == 0


@pytest.mark.parametrize("mode", ["sum", "per_sample", "median", "trim20", "trim35", "p10", "hybrid"])
def test_hypotheses_have_every_score(mode):
    h = {"score": 8.0, "median": 1.0, "trim20": 2.0, "trim35": 3.0, "p10": 4.0}
    want = {"sum": 8.0, "per_sample": 2.0, "median": 1.0, "trim20": 2.0, "trim35": 3.0, "p10": 4.0, "hybrid": 0.35 * 2 + 0.65 * 2}
    assert kernels.hypothesis_score(h, mode, 4) == pytest.approx(want[mode])


def test_closest_points_take_several_features_and_leave_short_queries():
    rng = np.random.default_rng(8)
    pos = np.arange(0.0, 80.0, 0.5)
    ref = np.stack([np.cumsum(rng.normal(size=160)), np.cumsum(rng.normal(size=160))], axis=1)
    q = np.arange(20.0, 40.0, 0.5)
    laid = np.stack([np.interp(q + 3.0, pos, f) for f in ref.T], axis=1)
    assert kernels.iccp(q, laid, pos, ref, 2.0) == pytest.approx(3.0, abs=0.11)
    assert kernels.iccp(q[:20], laid[:20], pos, ref, 2.0) == 2.0


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_warping_distance_is_that_of_all_warps(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=5), rng.normal(size=5)

    def least(i, j):
        if i == 0 and j == 0:
            return 0.0
        if i == 0 or j == 0:
            return np.inf
        return abs(a[i - 1] - b[j - 1]) + min(least(i - 1, j), least(i, j - 1), least(i - 1, j - 1))

    assert kernels.dtw_distance(a, b, 1.0) == pytest.approx(least(5, 5) / 10)
