"""Sequential kernels in numpy, without Spark: dynamic programmes, warps, filters, solvers.

Grouped operators in ``localize`` feed them one pass (and configuration) at a time.
"""

from __future__ import annotations

import numpy as np

FLOOR = -1e6


def log_likelihood(obs: np.ndarray, ref: np.ndarray, sigma: float, robust: bool = True, nu: float = 3.0) -> np.ndarray:
    """(times, states) log-likelihood of one feature, on one map or on one of each time; missing values give FLOOR, each row's greatest is 0."""
    z = (obs[:, None] - ref) / sigma
    ll = -0.5 * (nu + 1) * np.log1p(z * z / nu) if robust else -0.5 * z * z
    return normalise(np.where(np.isfinite(ll), ll, np.nan))


def normalise(ll: np.ndarray) -> np.ndarray:
    """Subtract each row's greatest finite value; missing entries FLOOR; an empty row is flat zero."""
    bad = ~np.isfinite(ll)
    top = np.where(bad, -np.inf, ll).max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.where(bad, FLOOR, ll - top)
    out[bad.all(axis=1)] = 0.0
    return out


def reach_of(vmax: float, dt: float, cell: float) -> int:
    """Cells that a move may take: the bound rounded up, one at least."""
    return max(1, int(np.ceil(vmax * dt / cell - 1e-9)))


def percentile_gate(ll: np.ndarray, gap: int, least: float, offset: float, span: float) -> np.ndarray:
    """Rows scaled by how far their best stands above the value ``gap`` ranks below it."""
    ranked = np.sort(ll, axis=1)
    margin = ranked[:, -1] - ranked[:, max(0, ll.shape[1] - 1 - gap)]
    return ll * np.clip((margin - offset) / span, least, 1.0)[:, None]


def step_viterbi(ll: np.ndarray, expected: int, sigma: float, jump: int) -> tuple[int, float]:
    """Window placed by steps of about ``expected`` states with a Gaussian prior, at most ``jump`` off. -> first state, score per sample."""
    times, states = ll.shape
    moves = np.arange(expected - jump, expected + jump + 1)
    dp, back = ll[0].astype(float), np.zeros((times, states), dtype=np.int32)
    before = np.arange(states)[None, :] - moves[::-1, None]  # ascending predecessor
    inside = (before >= 0) & (before < states)
    prior = -0.5 * ((moves[::-1] - expected) / sigma) ** 2
    for t in range(1, times):
        total = np.where(inside, dp[np.clip(before, 0, states - 1)], -np.inf) + prior[:, None]
        pick = total.argmax(axis=0)
        back[t] = before[pick, np.arange(states)]
        dp = total[pick, np.arange(states)] + ll[t]
    state = int(dp.argmax())
    score = float(dp[state] / times)
    for t in range(times - 1, 0, -1):
        state = int(back[t, state])
    return state, score


def step_viterbi_batch(ll: np.ndarray, expected: int, sigma: float, jump: int) -> tuple[np.ndarray, np.ndarray]:
    """``step_viterbi`` of many windows of one length at once, (windows, times, states)."""
    windows, times, states = ll.shape
    moves = np.arange(expected - jump, expected + jump + 1)[::-1]  # ascending predecessor
    prior = -0.5 * ((moves - expected) / sigma) ** 2
    dp, back, every = ll[:, 0].astype(float), np.zeros((times, windows, states), dtype=np.int32), np.arange(states)
    for t in range(1, times):
        best, pick = np.full((windows, states), -np.inf), np.full((windows, states), -moves[0] + every)
        for m, cost in zip(moves, prior, strict=True):  # the first of equal ones stays
            lo, hi = max(0, m), min(states, states + m)
            if lo < hi:
                total = dp[:, lo - m : hi - m] + cost
                better = total > best[:, lo:hi]
                best[:, lo:hi] = np.where(better, total, best[:, lo:hi])
                pick[:, lo:hi] = np.where(better, every[lo:hi] - m, pick[:, lo:hi])
        back[t], dp = pick, best + ll[:, t]
    one, state = np.arange(windows), dp.argmax(axis=1)
    score = dp[one, state] / times
    for t in range(times - 1, 0, -1):
        state = back[t, one, state]
    return state, score


def best_and_rival(ll: np.ndarray, dist: np.ndarray, exclude: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the first state of the greatest score (scores the same up to nine decimals are equal), the greatest score, and the
    greatest of the states further than ``exclude`` from that state (NaN: there is none)."""
    best = np.floor(ll * 1e9 + 0.5).argmax(axis=1)
    far = np.abs(dist[None, :] - dist[best][:, None]) > exclude
    rival = np.where(far, ll, -np.inf).max(axis=1)
    return best, ll.max(axis=1), np.where(far.any(axis=1), rival, np.nan)


def uniqueness_gate(ll: np.ndarray, dist: np.ndarray, exclude: float, least: float, offset: float, span: float) -> np.ndarray:
    """Rows scaled by how far their best stands above the best at ``exclude`` or further."""
    best = ll.argmax(axis=1)
    far = np.abs(dist[None, :] - dist[best][:, None]) > exclude
    rival = np.where(far, ll, -np.inf).max(axis=1)
    margin = np.where(np.isfinite(rival), ll.max(axis=1) - rival, 0.0)
    return ll * np.clip((margin - offset) / span, least, 1.0)[:, None]


def viterbi(
    ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, direction: int = 0, smooth: float = 0.0, speed: np.ndarray | None = None,
    speed_sigma: float = 0.35, speed_weight: float = 0.0, start: np.ndarray | None = None, mode: str = "exact", step: np.ndarray | None = None, step_sigma: float = 1.0, step_weight: float = 0.0,
) -> dict:
    """Most likely path over states within the speed bound.

    ``direction`` 1 allows forward moves only, -1 backward, 0 both. Move penalties: smoothness, unsigned speed and signed
    step priors. ``mode`` 'exact' maximises score and penalty together; 'greedy' picks the predecessor by score alone and
    charges the penalty afterwards. Equal choices: the first state. A state without a predecessor in reach keeps its own.
    -> path, score, margin (best end minus the 99th percentile), fallback (a time without any reachable state).
    """
    times, states = ll.shape
    cell = float(np.median(np.diff(dist))) if states > 1 else 1.0
    dp = ll[0] + (0.0 if start is None else start)
    back = np.full((times, states), -1, dtype=np.int32)
    fallback, known = False, {}  # moves and predecessors by reach
    for t in range(1, times):
        reach = reach_of(vmax, dt[t], cell)
        if reach not in known:
            moves = np.arange(0 if direction > 0 else -reach, (0 if direction < 0 else reach) + 1)  # state minus predecessor
            before = np.arange(states)[None, :] - moves[::-1, None]  # ascending predecessor
            known[reach] = moves, before, (before >= 0) & (before < states), np.clip(before, 0, states - 1)
        moves, before, inside, clipped = known[reach]
        penalty = np.zeros(len(moves))
        v = moves * cell / max(dt[t], 1e-6)
        if smooth:
            penalty -= smooth * v * v
        if speed is not None and speed_weight and np.isfinite(speed[t]):
            penalty -= speed_weight * 0.5 * ((np.abs(v) - speed[t]) / speed_sigma) ** 2
        if step is not None and step_weight and np.isfinite(step[t]):
            penalty -= step_weight * 0.5 * ((moves * cell - step[t]) / step_sigma) ** 2
        score = np.where(inside, dp[clipped], -np.inf)
        total = score + penalty[::-1, None]
        pick = (total if mode == "exact" else score).argmax(axis=0)
        best = total[pick, np.arange(states)]
        ok = np.isfinite(best)
        fallback |= not ok.any()
        back[t] = np.where(ok, before[pick, np.arange(states)], np.arange(states))
        dp = np.where(ok, best, dp + FLOOR) + ll[t]
    end = int(dp.argmax())
    path = np.empty(times, dtype=np.int64)
    path[-1] = end
    for t in range(times - 1, 0, -1):
        path[t - 1] = back[t, path[t]] if back[t, path[t]] >= 0 else path[t]
    return {"path": path, "score": float(dp[end]), "margin": float(dp[end] - np.percentile(dp, 99)), "fallback": bool(fallback), "dp": dp, "back": back}


def viterbi_batch(ll: np.ndarray, rows: np.ndarray, dist: np.ndarray, period: float, vmax: float, direction: int = 0, smooth: float = 0.0, speed: np.ndarray | None = None, speed_sigma: float = 0.35, speed_weight: float = 0.0, start: np.ndarray | None = None, mode: str = "exact", step: np.ndarray | None = None, step_sigma: float = 1.0, step_weight: float = 0.0, lag: int | None = None) -> dict:
    """``viterbi`` of many passes at once, a time of all of them as one step; the same paths, scores and margins.

    ``ll`` is (passes, times, states), padded behind each pass's own ``rows``; speed, step and start have a row for each pass. With ``lag``
    ``path`` has the state at each time as known so many samples later (``fixed_lag``).
    """
    passes, times, states = ll.shape
    cell = float(np.median(np.diff(dist))) if states > 1 else 1.0
    reach, every = reach_of(vmax, period, cell), np.arange(states)
    moves = np.arange(0 if direction > 0 else -reach, (0 if direction < 0 else reach) + 1)[::-1]  # ascending predecessor
    v = moves * cell / max(period, 1e-6)
    dp = ll[:, 0] + (0.0 if start is None else start)
    back = np.full((times, passes, states), -1, dtype=np.int32)
    fallback = np.zeros(passes, dtype=bool)
    ends = np.empty((passes, times), dtype=np.int64) if lag is not None else None
    if ends is not None:
        ends[:, 0] = dp.argmax(axis=1)
    for t in range(1, times):
        penalty = np.zeros((passes, len(moves)))
        if smooth:
            penalty -= smooth * v * v
        if speed is not None and speed_weight:
            penalty -= np.where(np.isfinite(speed[:, t, None]), speed_weight * 0.5 * ((np.abs(v) - speed[:, t, None]) / speed_sigma) ** 2, 0.0)
        if step is not None and step_weight:
            penalty -= np.where(np.isfinite(step[:, t, None]), step_weight * 0.5 * ((moves * cell - step[:, t, None]) / step_sigma) ** 2, 0.0)
        top, best, pick = np.full((passes, states), -np.inf), np.full((passes, states), -np.inf), np.tile(every - moves[0], (passes, 1))
        for k, m in enumerate(moves):  # the first of equal ones stays
            lo, hi = max(0, m), min(states, states + m)
            if lo >= hi:
                continue
            at = dp[:, lo - m : hi - m]
            total = at + penalty[:, k, None]
            better = (total if mode == "exact" else at) > top[:, lo:hi]
            top[:, lo:hi] = np.where(better, total if mode == "exact" else at, top[:, lo:hi])
            best[:, lo:hi] = np.where(better, total, best[:, lo:hi])
            pick[:, lo:hi] = np.where(better, every[lo:hi] - m, pick[:, lo:hi])
        ok = np.isfinite(best)
        live = t < rows
        fallback |= live & ~ok.any(axis=1)
        back[t] = np.where(ok, pick, every)
        dp = np.where(live[:, None], np.where(ok, best, dp + FLOOR) + ll[:, t], dp)
        if ends is not None:
            ends[:, t] = dp.argmax(axis=1)
    one, path, last = np.arange(passes), np.zeros((passes, times), dtype=np.int64), rows - 1
    if lag is None:
        state = dp.argmax(axis=1)
        for t in range(times - 1, -1, -1):
            path[:, t] = state
            if t:
                state = np.where(t <= last, back[t, one, state], state)
    else:
        at = np.arange(times)[None, :]
        known = np.minimum(at + lag, last[:, None])
        path = ends[one[:, None], known]
        for back_by in range(lag):
            t = known - back_by
            path = np.where((t > at) & (t > 0), back[np.maximum(t, 0), one[:, None], path], path)
    return {"path": path, "score": dp.max(axis=1), "margin": dp.max(axis=1) - np.percentile(dp, 99, axis=1), "fallback": fallback, "dp": dp, "back": back}


def fixed_lag(ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, lag: int, **kw) -> np.ndarray:
    """State at each time as known ``lag`` samples later; only the last ``lag`` back pointers are kept."""
    times, states = ll.shape
    out, ring, dp = np.empty(times, dtype=np.int64), [], None
    for t in range(times):
        if dp is None:
            dp = ll[0] + (0.0 if kw.get("start") is None else kw["start"])
        else:
            now = viterbi(np.stack([dp, ll[t]]), dist, np.array([0.0, dt[t]]), vmax, direction=kw.get("direction", 0), smooth=kw.get("smooth", 0.0), mode=kw.get("mode", "exact"))
            dp = now["dp"]
            ring.append(now["back"][1])
            ring = ring[-lag:] if lag else []
        if t >= lag:
            out[t - lag] = _rewind(ring, int(dp.argmax()))
    for k in range(min(lag, times)):  # the tail is read from the end
        out[times - 1 - k] = _rewind(ring[len(ring) - k :], int(dp.argmax()))
    return out


def _rewind(pointers: list[np.ndarray], state: int) -> int:
    for p in pointers[::-1]:
        state = int(p[state])
    return state


def switching_viterbi(ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, switch: float, opposite_start: float = 0.0, edge: float = 0.0, first: int = 1, edge_m: float = 5.0, smooth: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Path over (direction, position) with penalties for turning, for speed, and for dwelling within ``edge_m`` of an end. -> positions, directions.

    The predecessor is chosen by score and turning; the other penalties are charged afterwards.
    """
    times, states = ll.shape
    cell = float(np.median(np.diff(dist)))
    ways = (1, -1)
    dp = np.stack([ll[0] - (0.0 if w == first else opposite_start) for w in ways])
    back = np.zeros((times, 2, states, 2), dtype=np.int32)
    rows = np.arange(states)
    at_edge = (dist <= dist[0] + edge_m) | (dist >= dist[-1] - edge_m)
    for t in range(1, times):
        reach = reach_of(vmax, dt[t], cell)
        new = np.empty_like(dp)
        for d, w in enumerate(ways):
            before = rows[None, :] - w * np.arange(reach + 1)[:, None]
            inside = (before >= 0) & (before < states)
            options = [np.where(inside, dp[e][np.clip(before, 0, states - 1)], -np.inf) - (switch if e != d else 0.0) for e in range(2)]
            best = [o.argmax(axis=0) for o in options]
            value = np.stack([o[b, rows] for o, b in zip(options, best, strict=True)])
            e = value.argmax(axis=0)
            back[t, d, :, 0] = e
            back[t, d, :, 1] = np.where(e == 0, before[best[0], rows], before[best[1], rows])
            moved = np.abs(rows - back[t, d, :, 1]) * cell
            new[d] = value[e, rows] + ll[t] - smooth * (moved / max(dt[t], 1e-6)) ** 2 - np.where(at_edge & (moved < 0.25), edge, 0.0)
        dp = new
    d, s = np.unravel_index(int(dp.argmax()), dp.shape)
    path, way = np.empty(times, dtype=np.int64), np.empty(times, dtype=np.int64)
    for t in range(times - 1, -1, -1):
        path[t], way[t] = s, ways[d]
        if t:
            d, s = back[t, d, s]
    return path, way


def switching_batch(ll: np.ndarray, rows: np.ndarray, dist: np.ndarray, period: float, vmax: float, switch: float, opposite_start: float = 0.0, edge: float = 0.0, first: int = 1, edge_m: float = 5.0, smooth: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """``switching_viterbi`` of many passes at once ((passes, times, states), padded behind ``rows``)."""
    passes, times, states = ll.shape
    cell = float(np.median(np.diff(dist)))
    ways, reach, every, one = (1, -1), reach_of(vmax, period, cell), np.arange(states), np.arange(passes)
    dp = np.stack([ll[:, 0] - (0.0 if w == first else opposite_start) for w in ways], axis=1)
    back = np.zeros((times, passes, 2, states), dtype=np.int32)  # the earlier direction's number, times states, and position
    at_edge = (dist <= dist[0] + edge_m) | (dist >= dist[-1] - edge_m)
    for t in range(1, times):
        new = np.empty_like(dp)
        for d, w in enumerate(ways):
            best, pick = np.full((2, passes, states), -np.inf), np.tile(every, (2, passes, 1))
            for e in range(2):
                for k in range(reach + 1):  # the first of equal ones stays
                    lo, hi = max(0, w * k), min(states, states + w * k)
                    if lo < hi:
                        value = dp[:, e, lo - w * k : hi - w * k] - (switch if e != d else 0.0)
                        better = value > best[e, :, lo:hi]
                        best[e, :, lo:hi] = np.where(better, value, best[e, :, lo:hi])
                        pick[e, :, lo:hi] = np.where(better, every[lo:hi] - w * k, pick[e, :, lo:hi])
            turned = best[1] > best[0]
            before = np.where(turned, pick[1], pick[0])
            back[t, :, d] = turned * states + before
            moved = np.abs(every - before) * cell
            new[:, d] = np.where(turned, best[1], best[0]) + ll[:, t] - smooth * (moved / max(period, 1e-6)) ** 2 - np.where(at_edge & (moved < 0.25), edge, 0.0)
        dp = np.where((t < rows)[:, None, None], new, dp)
    state = dp.reshape(passes, -1).argmax(axis=1)
    path, way = np.zeros((passes, times), dtype=np.int64), np.ones((passes, times), dtype=np.int64)
    for t in range(times - 1, -1, -1):
        d, s = np.divmod(state, states)
        path[:, t], way[:, t] = s, np.array(ways)[d]
        if t:
            state = np.where(t < rows, back[t, one, d, s], state)
    return path, way


def separated_top(score: np.ndarray, dist: np.ndarray, k: int, separation: float) -> list[int]:
    """Greedy best positions at least ``separation`` apart."""
    kept: list[int] = []
    for i in np.argsort(-score, kind="stable"):
        if np.isfinite(score[i]) and all(abs(dist[i] - dist[j]) >= separation for j in kept):
            kept.append(int(i))
            if len(kept) == k:
                break
    return kept


def delayed_hypotheses(ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, warmup: int, k: int = 8, separation: float = 50.0, sigma: float = 8.0, **kw) -> list[dict]:
    """Warm up, keep the best separated end positions, and run each on with a prior around it. -> one entry for each hypothesis."""
    w = min(warmup, len(ll))
    first = viterbi(ll[:w], dist, dt[:w], vmax, **kw)
    out = []
    for h in separated_top(first["dp"], dist, k, separation):
        prior = first["dp"][h] - 0.5 * ((dist - dist[h]) / max(sigma, 1e-3)) ** 2
        path = np.empty(len(ll), dtype=np.int64)
        state = h
        for t in range(w - 1, -1, -1):
            path[t] = state
            if t:
                state = int(first["back"][t, state])
        if w < len(ll):
            rest = viterbi(ll[w:], dist, dt[w:], vmax, start=prior, **kw)
            path[w:], score = rest["path"], rest["score"]
        else:
            score = float(first["dp"][h])
        seen = ll[np.arange(len(ll)), path]
        trim = lambda q: float(np.sort(seen)[int(len(seen) * q) :].mean())
        out.append({"path": path, "score": score, "mean": float(seen.mean()), "median": float(np.median(seen)), "p10": float(np.percentile(seen, 10)), "trim20": trim(0.2), "trim35": trim(0.35)})
    return out


def separated_tops(score: np.ndarray, dist: np.ndarray, k: int, separation: float) -> tuple[np.ndarray, np.ndarray]:
    """``separated_top`` of each row of scores: row and position, the rows in order and each one's best first."""
    left, one = np.where(np.isfinite(score), score, -np.inf), np.arange(len(score))
    rows, tops, ranks = [], [], []
    for rank in range(k):
        top = left.argmax(axis=1)
        on = np.flatnonzero(np.isfinite(left[one, top]))
        if not len(on):
            break
        rows, tops, ranks = [*rows, on], [*tops, top[on]], [*ranks, np.full(len(on), rank)]
        left[np.abs(dist[None, :] - dist[top][:, None]) < separation] = -np.inf
        left[one, top] = -np.inf
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    row, top, rank = (np.concatenate(x) for x in (rows, tops, ranks))
    order = np.lexsort((rank, row))
    return row[order], top[order]


def delayed_hypotheses_batch(ll: np.ndarray, rows: np.ndarray, dist: np.ndarray, period: float, vmax: float, warmup: int, k: int = 8, separation: float = 50.0, sigma: float = 8.0, **kw) -> dict:
    """``delayed_hypotheses`` of many passes at once ((passes, times, states), padded behind ``rows``): arrays with one entry for each hypothesis.

    -> pass, path (padded), score, mean, median, p10, trim20, trim35; a pass's hypotheses in the order of ``delayed_hypotheses``.
    """
    w = np.minimum(warmup, rows)
    first = viterbi_batch(ll[:, : w.max()], w, dist, period, vmax, **kw)
    of, state = separated_tops(first["dp"], dist, k, separation)
    prior = first["dp"][of, state][:, None] - 0.5 * ((dist[None, :] - dist[state][:, None]) / max(sigma, 1e-3)) ** 2
    path, score = np.zeros((len(of), ll.shape[1]), dtype=np.int64), first["dp"][of, state]
    for t in range(w.max() - 1, -1, -1):
        path[:, t] = state
        if t:
            state = np.where(t < w[of], first["back"][t, of, state], state)
    on = np.flatnonzero(rows[of] > w[of])
    if len(on):  # those passes have all of the warm-up
        rest = viterbi_batch(ll[of[on], warmup:], rows[of[on]] - warmup, dist, period, vmax, start=prior[on], **kw)
        path[on, warmup:], score[on] = rest["path"], rest["score"]
    every, n = np.arange(ll.shape[1])[None, :], rows[of]
    seen = np.where(every < n[:, None], ll[of[:, None], every, path], np.inf)
    out = {"pass": of, "path": path, "score": score, **{x: np.empty(len(of)) for x in ("mean", "median", "p10", "trim20", "trim35")}}
    for size in np.unique(n):
        own = np.flatnonzero(n == size)
        raw = np.ascontiguousarray(seen[own, :size])
        ordered = np.sort(raw, axis=1)
        out["mean"][own], out["median"][own], out["p10"][own] = raw.mean(axis=1), np.median(ordered, axis=1), np.percentile(ordered, 10, axis=1)
        for name, q in (("trim20", 0.2), ("trim35", 0.35)):
            out[name][own] = np.ascontiguousarray(ordered[:, int(size * q) :]).mean(axis=1)
    return out


def hypothesis_score(h: dict, mode: str, times: int) -> float:
    """Score of a hypothesis by one of the modes."""
    per_sample = h["score"] / times
    return {"sum": h["score"], "per_sample": per_sample, "median": h["median"], "trim20": h["trim20"], "trim35": h["trim35"], "p10": h["p10"], "hybrid": 0.35 * per_sample + 0.65 * h["trim20"]}[mode]


def piecewise_path(ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, turn: int, direction: int = 1, sigma: float = 20.0, **kw) -> np.ndarray:
    """Path in one direction up to row ``turn`` and in the other from there, started by a prior around the first part's end."""
    if turn <= 0 or turn >= len(ll):
        return viterbi(ll, dist, dt, vmax, direction=direction if turn > 0 else -direction, **kw)["path"]
    head = viterbi(ll[:turn], dist, dt[:turn], vmax, direction=direction, **kw)["path"]
    kw["start"] = -0.5 * ((dist - dist[head[-1]]) / sigma) ** 2
    return np.concatenate([head, viterbi(ll[turn:], dist, dt[turn:], vmax, direction=-direction, **kw)["path"]])


def suffix_path(ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, turn: int, step: np.ndarray, step_sigma: float, step_weight: float, sigma: float = 20.0, **kw) -> np.ndarray:
    """Bounded path up to row ``turn``; from there signed steps hold, started by a prior around the first part's end."""
    if turn <= 0 or turn >= len(ll):
        return viterbi(ll, dist, dt, vmax, **kw)["path"]
    head = viterbi(ll[:turn], dist, dt[:turn], vmax, **kw)["path"]
    tail = viterbi(ll[turn:], dist, dt[turn:], vmax, **(kw | {"direction": 0, "start": -0.5 * ((dist - dist[head[-1]]) / sigma) ** 2, "step": step[turn:], "step_sigma": step_sigma, "step_weight": step_weight}))
    return np.concatenate([head, tail["path"]])


def particle_filter(ll: np.ndarray, dist: np.ndarray, dt: np.ndarray, vmax: float, particles: int = 2500, seed: int = 0, jitter: float = 0.5) -> np.ndarray:
    """Weighted mean position at each time; systematic resampling below half the effective size. Seeded by the caller, so runs repeat."""
    rng = np.random.default_rng(seed)
    x, weight = rng.uniform(dist[0], dist[-1], particles), np.full(particles, 1.0 / particles)
    out = np.empty(len(ll))
    for t in range(len(ll)):
        if t:
            x = np.clip(x + rng.uniform(-vmax, vmax, particles) * dt[t] + rng.normal(0, jitter, particles), dist[0], dist[-1])
        weight = weight * np.exp(np.interp(x, dist, ll[t]))
        total = weight.sum()
        weight = weight / total if total > 0 and np.isfinite(total) else np.full(particles, 1.0 / particles)
        out[t] = weight @ x
        if 1.0 / (weight @ weight) < 0.5 * particles:
            spots = (rng.random() + np.arange(particles)) / particles
            x = x[np.minimum(np.searchsorted(np.cumsum(weight), spots), particles - 1)]
            weight = np.full(particles, 1.0 / particles)
    return out


def dtw_distance(a: np.ndarray, b: np.ndarray, band: float = 0.08) -> float:
    """Dynamic time warping distance of absolute differences in a band (share of the length), divided by n + m."""
    n, m = len(a), len(b)
    width = max(abs(n - m), int(np.ceil(band * max(n, m))), 1)
    prev = np.full(m + 1, np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        now = np.full(m + 1, np.inf)
        lo, hi = max(1, i - width), min(m, i + width)
        cost = np.abs(a[i - 1] - b[lo - 1 : hi])
        base = np.minimum(prev[lo : hi + 1], prev[lo - 1 : hi])
        left = np.inf
        for j in range(lo, hi + 1):
            left = cost[j - lo] + min(base[j - lo], left)
            now[j] = left
        prev = now
    return float(prev[m] / (n + m))


def warp_path(cost: np.ndarray, allowed: np.ndarray | None = None, open_ends: bool = True) -> tuple[float, np.ndarray]:
    """Least-cost warp of rows onto columns; with ``open_ends`` it may begin and end at any column. -> cost, column of each row (-1: infeasible).

    Choices of equal cost: from above, then from the left, then diagonal.
    """
    n, m = cost.shape
    c = cost if allowed is None else np.where(allowed, cost, np.inf)
    acc = np.full((n, m), np.inf)
    move = np.zeros((n, m), dtype=np.int8)
    acc[0] = c[0] if open_ends else np.cumsum(c[0])
    if not open_ends:
        move[0, 1:] = 1
    for i in range(1, n):
        up, diag = acc[i - 1], np.concatenate([[np.inf], acc[i - 1, :-1]])
        left = np.inf
        for j in range(m):
            best, k = up[j], 0
            if left < best:
                best, k = left, 1
            if diag[j] < best:
                best, k = diag[j], 2
            left = acc[i, j] = best + c[i, j]
            move[i, j] = k
    j = int(acc[-1].argmin()) if open_ends else m - 1
    total = float(acc[-1, j])
    out = np.full(n, -1, dtype=np.int64)
    if not np.isfinite(total):
        return total, out
    i = n - 1
    while True:
        if out[i] < 0:
            out[i] = j
        if i == 0 and (open_ends or j == 0):
            break
        k = move[i, j]
        i, j = (i - 1, j) if k == 0 else (i, j - 1) if k == 1 else (i - 1, j - 1)
    return total, out


def banded_warp(qs: np.ndarray, q: np.ndarray, rs: np.ndarray, ref: np.ndarray, band: float = 60.0) -> tuple[float, np.ndarray]:
    """Subsequence warp where a query point may only meet reference points within ``band`` of its own coordinate."""
    return warp_path((q[:, None] - ref[None, :]) ** 2, np.abs(qs[:, None] - rs[None, :]) <= band)


def affine_score(q: np.ndarray, r: np.ndarray, ridge: float = 1e-2) -> float:
    """Negative RMSE of the ridge regression of reference features on query features, the bias unpenalised."""
    x = np.column_stack([q, np.ones(len(q))])
    pen = np.diag([ridge] * q.shape[1] + [0.0])
    beta = np.linalg.solve(x.T @ x + pen, x.T @ r)
    return -float(np.sqrt(np.mean((x @ beta - r) ** 2)))


def iccp(
    q_pos: np.ndarray, q: np.ndarray, r_pos: np.ndarray, ref: np.ndarray, offset: float, gate: float = 8.0, rounds: int = 10, trim: float = 2.5,
    settle: float = 0.05, polish: float = 2.0, least: int = 30, matched: int = 10,
) -> float:
    """Refine an offset by nearest features. ``q`` and ``ref`` hold one feature, or a column for each.

    Each sample takes the reference point within ``gate`` whose features, scaled by their spread there, are nearest. The offset
    becomes the mean of the samples' offsets within ``trim`` robust deviations of the median, until it moves less than
    ``settle``; then the least squared difference within ``polish`` in steps of 0.1 decides. With fewer than ``least`` usable
    samples on a side the offset stays.
    """
    q, ref = q.reshape(len(q), -1), ref.reshape(len(ref), -1)
    own, other = np.isfinite(q).all(axis=1), np.isfinite(ref).all(axis=1)
    if own.sum() < least or other.sum() < least:
        return float(offset)
    q_pos, q, r_pos, ref = q_pos[own], q[own], r_pos[other], ref[other]
    for _ in range(rounds):
        shifts = []
        for x, f in zip(q_pos, q, strict=True):
            near = np.flatnonzero(np.abs(r_pos - x - offset) <= gate)
            if len(near) >= 2:
                scale = ref[near].std(axis=0)
                gap = (((ref[near] - f) / np.where(scale < 1e-6, 1.0, scale)) ** 2).sum(axis=1)
                shifts.append(r_pos[near[gap.argmin()]] - x)
        if len(shifts) < matched:
            break
        shifts = np.array(shifts)
        off = np.abs(shifts - np.median(shifts))
        spread = 1.4826 * np.median(off)
        if spread < 1e-6:
            spread = shifts.std() if shifts.std() > 1e-6 else 1.0
        before, offset = offset, float(shifts[off <= trim * spread].mean())
        if abs(offset - before) < settle:
            break
    tries = offset + np.arange(-round(polish * 10), round(polish * 10) + 1) * 0.1
    return float(tries[int(np.argmin([shift_cost(q_pos + o, q, r_pos, ref) for o in tries]))])


def shift_cost(at: np.ndarray, q: np.ndarray, r_pos: np.ndarray, ref: np.ndarray, least: int = 3) -> float:
    """Mean squared difference of the standardised features where they overlap."""
    inside = (at >= r_pos[0]) & (at <= r_pos[-1])
    if inside.sum() < least:
        return np.inf
    z = lambda x: (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    laid = np.stack([np.interp(at[inside], r_pos, column) for column in ref.T], axis=1)
    return float(np.mean((z(q[inside]) - z(laid)) ** 2))


#: Numbers of a work array where many passes are refined together.
WORK = 1_000_000


def shift_costs(at: np.ndarray, q: np.ndarray, rows: np.ndarray, shifts: np.ndarray, r_pos: np.ndarray, ref: np.ndarray, least: int = 3) -> np.ndarray:
    """``shift_cost`` of many passes (passes, places; padded behind ``rows``) of one feature, under every shift of each: (passes, shifts)."""
    laid_at = at[:, None, :] + shifts[:, :, None]
    inside = (laid_at >= r_pos[0]) & (laid_at <= r_pos[-1]) & (np.arange(at.shape[1]) < rows[:, None])[:, None, :]
    n = inside.sum(axis=2)

    def standard(x: np.ndarray) -> np.ndarray:
        off = np.where(inside, x - (np.where(inside, x, 0.0).sum(axis=2) / np.maximum(n, 1))[..., None], 0.0)
        sd = np.sqrt((off * off).sum(axis=2) / np.maximum(n, 1))
        return off / np.where(sd > 1e-9, sd, 1.0)[..., None]

    gap = standard(np.broadcast_to(q[:, None, :], laid_at.shape)) - standard(np.interp(laid_at, r_pos, ref))
    return np.where(n < least, np.inf, (gap * gap).sum(axis=2) / np.maximum(n, 1))


def iccp_batch(q_pos: np.ndarray, q: np.ndarray, rows: np.ndarray, r_pos: np.ndarray, ref: np.ndarray, offset: np.ndarray, gate: float = 8.0, rounds: int = 10, trim: float = 2.5, settle: float = 0.05, polish: float = 2.0, least: int = 30, matched: int = 10) -> np.ndarray:
    """``iccp`` of many passes of one feature at once (passes, places; padded behind ``rows``), all values finite, ``r_pos`` ascending: offsets."""
    offset, long = offset.astype(float), rows >= least
    if len(ref) < least or not long.any():
        return offset
    spreads: dict[int, float] = {}
    live = np.flatnonzero(long)
    for _ in range(rounds):
        of, place = np.nonzero(np.arange(q.shape[1]) < rows[live, None])
        x, f, by = q_pos[live[of], place], q[live[of], place], offset[live[of]]
        low, high = _within(r_pos, x, by, gate)
        near = high - low >= 2
        at = _nearest(ref, f[near], low[near], high[near], spreads)
        moves, of = r_pos[at] - x[near], of[near]
        count = np.bincount(of, minlength=len(live))
        ends = np.cumsum(count)
        padded = np.full((len(live), max(1, int(count.max()))), np.inf)
        padded[of, np.arange(len(of)) - (ends - count)[of]] = moves
        enough = count >= matched
        off = np.abs(padded - _middle(padded, count)[:, None])
        spread = 1.4826 * _middle(off, count)
        go = enough.copy()
        for k in np.flatnonzero(enough):
            own, wide = moves[ends[k] - count[k] : ends[k]], spread[k]
            if wide < 1e-6:
                wide = own.std() if own.std() > 1e-6 else 1.0
            before, offset[live[k]] = offset[live[k]], own[off[k, : count[k]] <= trim * wide].mean()
            go[k] = not abs(offset[live[k]] - before) < settle
        live = live[go]
        if not len(live):
            break
    steps = np.arange(-round(polish * 10), round(polish * 10) + 1) * 0.1
    live = np.flatnonzero(long)
    for part in np.array_split(live, max(1, -(-len(live) * len(steps) * q.shape[1] // WORK))):
        tries = offset[part, None] + steps
        offset[part] = tries[np.arange(len(part)), shift_costs(q_pos[part], q[part], rows[part], tries, r_pos, ref).argmin(axis=1)]
    return offset


def _within(r_pos: np.ndarray, x: np.ndarray, offset: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """First reference point of each sample with ``abs(r_pos - x - offset) <= gate``, and the first one behind them."""
    size = len(r_pos)
    away = lambda k: r_pos[np.clip(k, 0, size - 1)] - x - offset
    low, high = np.searchsorted(r_pos, x + offset - gate), np.searchsorted(r_pos, x + offset + gate, "right")
    for ends, side in ((low, -gate), (high, gate)):  # the search's bounds are rounded, so the points beside them are looked at
        beyond = (lambda k: away(k) >= -gate) if side < 0 else (lambda k: away(k) > gate)
        while (back := (ends > 0) & beyond(ends - 1)).any():
            ends -= back
        while (on := (ends < size) & ~beyond(ends)).any():
            ends += on
    return low, np.maximum(low, high)


def _nearest(ref: np.ndarray, f: np.ndarray, low: np.ndarray, high: np.ndarray, spreads: dict[int, float]) -> np.ndarray:
    """The reference point of each range whose value, scaled by the spread there, is nearest; the first of equal ones."""
    if not len(f):
        return low
    pairs, which = np.unique(low * (len(ref) + 1) + high, return_inverse=True)
    for k in pairs.tolist():
        if k not in spreads:
            sd = ref[k // (len(ref) + 1) : k % (len(ref) + 1)].std()
            spreads[k] = 1.0 if sd < 1e-6 else sd
    scale = np.array([spreads[k] for k in pairs.tolist()])[which]
    out, wide = np.empty(len(f), dtype=np.int64), int((high - low).max())
    for x in (slice(a, a + max(1, WORK // wide)) for a in range(0, len(f), max(1, WORK // wide))):
        at = low[x, None] + np.arange(wide)
        gap = ((ref[np.minimum(at, len(ref) - 1)] - f[x, None]) / scale[x, None]) ** 2
        out[x] = low[x] + np.where(at < high[x, None], gap, np.inf).argmin(axis=1)
    return out


def _middle(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Median of the first ``count`` values of each row, the others being infinite or NaN; of none, infinite."""
    ordered, one = np.sort(x, axis=1), np.arange(len(x))
    low, high = ordered[one, np.maximum(count - 1, 0) // 2], ordered[one, np.minimum(count // 2, x.shape[1] - 1)]
    return np.where(count > 0, (low + high) / 2, np.inf)


def pose_graph(odometry: np.ndarray, loops: list[tuple[int, int, float]], odom_sigma: float, loop_sigma: float, robust: bool = True, rounds: int = 6, huber: float = 1.5) -> np.ndarray:
    """Least-squares positions of a chain with loop measurements x[j] - x[i] = z; Huber weights are renewed each round. The first node stays.

    The normal matrix is a tridiagonal one and two entries for each loop; it is only ever multiplied, by conjugate gradients, so
    memory grows with nodes and loops.
    """
    x = odometry.astype(float).copy()
    n, chain = len(x), np.diff(odometry) if len(odometry) > 1 else np.empty(0)
    i, j, z = (np.array([e[k] for e in loops]) for k in range(3)) if loops else (np.empty(0, int), np.empty(0, int), np.empty(0))
    weight, w_chain = np.ones(len(z)), 1 / odom_sigma**2
    for _ in range(rounds if robust else 1):
        w = weight / loop_sigma**2

        def times(v: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            out = np.zeros(n)
            d = w_chain * np.diff(v)
            out[1:] += d
            out[:-1] -= d
            e = w * (v[j] - v[i])
            np.add.at(out, j, e)
            np.add.at(out, i, -e)
            out[0] = 0.0  # the first node stays
            return out

        goal = np.zeros(n)
        goal[1:] += w_chain * chain
        goal[:-1] -= w_chain * chain
        np.add.at(goal, j, w * z)
        np.add.at(goal, i, -w * z)
        goal[0] = 0.0
        diagonal = np.full(n, 2 * w_chain)
        diagonal[-1] = w_chain
        np.add.at(diagonal, i, w)
        np.add.at(diagonal, j, w)
        x = _conjugate_gradients(times, goal, x, diagonal, 20 * n + 100)
        res = np.abs(x[j] - x[i] - z) / loop_sigma
        weight = np.where(res <= huber, 1.0, huber / np.maximum(res, 1e-12))
    return x


def _conjugate_gradients(times, goal: np.ndarray, x: np.ndarray, diagonal: np.ndarray, most: int, tolerance: float = 1e-12) -> np.ndarray:
    r = goal - times(x)
    r[0] = 0.0
    p = r / diagonal
    rho = r @ p
    limit = tolerance * max(float(np.abs(goal).max(initial=0.0)), 1e-30)
    for _ in range(most):
        if np.abs(r).max(initial=0.0) <= limit:
            break
        ap = times(p)
        step = rho / (p @ ap)
        x = x + step * p
        r = r - step * ap
        y = r / diagonal
        rho, old = r @ y, rho
        p = y + rho / old * p
    return x


def sequence_likelihood(values: np.ndarray, travelled: np.ndarray, seconds: np.ndarray, ref: np.ndarray, dist: np.ndarray, direction: int, window_s: float, least: int = 8) -> np.ndarray:
    """(times, states): the scores of the window of ``window_s`` that ends at each time, brought to a likelihood; early times are flat."""
    out = np.full((len(values), len(dist)), np.nan)
    for t in range(len(values)):
        first = int(np.searchsorted(seconds, seconds[t] - window_s))
        if t - first + 1 >= least:
            out[t] = sequence_scores(values[first : t + 1], travelled[first : t + 1], ref, dist, direction, least)
    return normalise(out)


def sequence_scores(values: np.ndarray, travelled: np.ndarray, ref: np.ndarray, dist: np.ndarray, direction: int, least: int = 8) -> np.ndarray:
    """Correlation of a trailing window with the reference laid out behind every end state: newest sample at the state, older ones back along the way travelled."""
    behind = travelled[-1] - travelled
    at = dist[:, None] - direction * behind[None, :]  # (states, samples)
    ok = (at >= dist[0]) & (at <= dist[-1]) & np.isfinite(values)[None, :]
    n = ok.sum(axis=1)
    a = np.where(ok, np.nan_to_num(values)[None, :], 0.0)
    b = np.where(ok, np.interp(at, dist, ref), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        da, db = np.where(ok, a - a.sum(axis=1, keepdims=True) / n[:, None], 0.0), np.where(ok, b - b.sum(axis=1, keepdims=True) / n[:, None], 0.0)
        va, vb = (da * da).sum(axis=1), (db * db).sum(axis=1)
        out = (da * db).sum(axis=1) / np.sqrt(va * vb)
        flat = (np.sqrt(va / n) <= 1e-6) | (np.sqrt(vb / n) <= 1e-6)
    return np.where((n >= least) & ~flat, out, np.nan)
