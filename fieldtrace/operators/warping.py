"""Search for the place of least warping distance, exactly, with lower bounds that spare most places the warping.

The bounds cascade from cheap to dear: both ends; how far the map's values leave the envelope of the query; how far the query's
values leave the envelope of the map. Places are warped in the order of their bounds, many at once, and are given up when the best
cell of a row and the bound of what is left exceed the best distance found.
"""

from __future__ import annotations

import numpy as np

#: Places warped at once: at first, and at most.
FIRST, BATCH = 8, 64
#: Share by which a bound must exceed the best distance, for rounding.
SLACK = 1e-9


def sliding_extremes(v: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value within ``r`` places of each along the last axis, in time linear in the values: the window is a suffix of one
    run of 2r + 1 values and a prefix of the next, and both kinds are accumulated once."""
    w = 2 * r + 1
    *many, n = v.shape
    out = []
    for fold, empty in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        padded = np.full((*many, -(-(n + 2 * r) // w) * w), empty)
        padded[..., r : r + n] = v
        runs = padded.reshape(*many, -1, w)
        ahead = fold.accumulate(runs, axis=-1).reshape(padded.shape)
        back = fold.accumulate(runs[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
        out.append(fold(back[..., :n], ahead[..., w - 1 : w - 1 + n]))
    return out[0], out[1]


def band_width(n: int, m: int, band: float) -> int:
    return max(abs(n - m), int(np.ceil(band * max(n, m))), 1)


def warp_many(a: np.ndarray, b: np.ndarray, width: int, rest: np.ndarray, best: float | np.ndarray) -> np.ndarray:
    """Sums of absolute differences along the least warp of ``a`` (or of each column of it) onto each row of ``b``, in a band; infinite for a row given up.

    ``rest[:, i]`` bounds from below what the values of ``b`` from place i on must still cost; ``best`` is one distance, or one for each row.
    """
    n, m, k = len(a), b.shape[1], len(b)
    prev = np.full((m + 1, k), np.inf)
    prev[0] = 0.0
    out, alive, columns, rest = np.full(k, np.inf), np.arange(k), np.ascontiguousarray(b.T), rest.T
    limit = np.broadcast_to(best * (1 + SLACK) + SLACK, k)
    for i in range(1, n + 1):
        now = np.full((m + 1, len(alive)), np.inf)
        low, high = max(1, i - width), min(m, i + width)
        left = np.full(len(alive), np.inf)
        for j in range(low, high + 1):
            left = np.abs(a[i - 1] - columns[j - 1]) + np.minimum(np.minimum(prev[j], prev[j - 1]), left)
            now[j] = left
        # later rows meet at least the places behind the band; what they cost is still to come
        keep = now[low : high + 1].min(axis=0) + rest[min(high, m)] <= limit
        if not keep.all():
            now, columns, rest, alive, limit = now[:, keep], columns[:, keep], rest[:, keep], alive[keep], limit[keep]
            a = a[:, keep] if np.ndim(a) == 2 else a
            if not len(alive):
                return out
        prev = now
    out[alive] = prev[m]
    return out


class WarpSearch:
    """A map's places for windows of one length."""

    def __init__(self, reference: np.ndarray, n: int, stride: int = 1, band: float = 0.08) -> None:
        self.n, self.width = n, band_width(n, n, band)
        self.starts = np.arange(0, max(0, len(reference) - n + 1), stride)
        self.windows = np.lib.stride_tricks.sliding_window_view(reference, n)[self.starts] if len(self.starts) else np.empty((0, n))
        low, high = sliding_extremes(reference, self.width)
        cells = self.starts[:, None] + np.arange(n)
        self.low, self.high = low[cells], high[cells]

    def best(self, w: np.ndarray) -> tuple[float, int, int]:
        """Least distance (divided by both lengths together), the first start that has it, and how many starts were warped."""
        distance, place, warped = self.best_of(w[None, :])
        return float(distance[0]), int(place[0]), int(warped[0])

    def best_of(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of each row of ``w``; the rows' next places are warped together."""
        many, starts, one = len(w), len(self.starts), np.arange(len(w))
        best, place, warped = np.full(many, np.inf), np.full(many, -1), np.zeros(many, dtype=np.int64)
        if not starts:
            return best, place, warped
        low, high = sliding_extremes(w, self.width)
        beyond = np.maximum(np.maximum(self.windows - high[:, None], low[:, None] - self.windows), 0.0)
        bound = beyond.sum(axis=2)
        if self.n > 1:
            bound = np.maximum(bound, np.abs(self.windows[:, 0] - w[:, :1]) + np.abs(self.windows[:, -1] - w[:, -1:]))
        bound = np.maximum(bound, np.maximum(np.maximum(w[:, None] - self.high, self.low - w[:, None]), 0.0).sum(axis=2))
        rest = np.zeros((many, starts, self.n + 1))
        rest[:, :, :-1] = np.cumsum(beyond[:, :, ::-1], axis=2)[:, :, ::-1]
        order = np.argsort(bound, axis=1, kind="stable")
        at, size, live = 0, FIRST, one
        while at < starts and len(live):  # few at first, so that a good distance is known early
            part = order[live, at : at + size]
            at, size = at + size, min(2 * size, BATCH)
            near = bound[live[:, None], part] <= (best * (1 + SLACK) + SLACK)[live, None]
            some = near.any(axis=1)
            live, part, near = live[some], part[some], near[some]
            if not len(live):
                break
            which, column = np.nonzero(near)
            of, start = live[which], part[which, column]
            warped += np.bincount(of, minlength=many)
            cost = np.full(part.shape, np.inf)
            cost[which, column] = warp_many(w[of].T, self.windows[start], self.width, rest[of, start], best[of])
            least = cost.min(axis=1)
            first = np.where(near & (cost == least[:, None]), part, starts).min(axis=1)
            take = np.isfinite(least) & ((least < best[live]) | ((least == best[live]) & (first < place[live])))
            best[live[take]], place[live[take]] = least[take], first[take]
        return best / (2 * self.n), np.where(place >= 0, self.starts[np.maximum(place, 0)], -1), warped


# ---- paths
#: Diagonals between two kept ones: memory is that of so many diagonals of moves, and of one diagonal for each so many.
SEGMENT = 512


def warp_path(q: np.ndarray, ref: np.ndarray, qs: np.ndarray | None = None, rs: np.ndarray | None = None, band: float = np.inf, open_ends: bool = True, segment: int = SEGMENT) -> tuple[float, np.ndarray]:
    """Warp of least summed squared difference of ``q`` onto ``ref``: cost, and the last column of each row (-1: infeasible).

    With coordinates ``qs`` and ``rs`` only cells at most ``band`` apart may meet. With ``open_ends`` a path may begin and end at any column.
    Cells of one anti-diagonal do not depend on each other and are computed together. Moves are kept for one segment of diagonals at
    a time: on the way back a segment is computed once more from the diagonals kept at its beginning, so memory does not grow with
    the product of both lengths. Choices of equal cost: from above, then from the left, then diagonal.
    """
    n, m = len(q), len(ref)

    def wave(d: int, before: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now, move = np.full(n, np.inf), np.zeros(n, dtype=np.int8)
        low, high = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(low, high + 1)
        j = d - i
        cost = (q[i] - ref[j]) ** 2
        if np.isfinite(band):
            cost[np.abs(qs[i] - rs[j]) > band] = np.inf
        best = np.where(i > 0, before[i - 1], np.inf)
        left = np.where(j > 0, before[i], np.inf)
        across = np.where((i > 0) & (j > 0), earlier[i - 1], np.inf)
        kind = np.zeros(len(i), dtype=np.int8)
        for value, k in ((left, 1), (across, 2)):
            less = value < best
            best, kind = np.where(less, value, best), np.where(less, np.int8(k), kind)
        if low == 0:
            best[0] = 0.0 if open_ends or d == 0 else left[0]
            kind[0] = 0 if open_ends else 1
        now[i], move[i] = best + cost, kind
        return now, move

    nothing = np.full(n, np.inf)
    kept, last = [], np.full(m, np.inf)
    before, earlier = nothing, nothing
    for d in range(n + m - 1):
        if d % segment == 0:
            kept.append((before, earlier))
        now, _ = wave(d, before, earlier)
        if d >= n - 1:
            last[d - n + 1] = now[n - 1]
        before, earlier = now, before
    out = np.full(n, -1, dtype=np.int64)
    j = int(last.argmin()) if open_ends else m - 1
    total = float(last[j])
    if not np.isfinite(total):
        return total, out
    i, at, moves = n - 1, -1, []
    while True:
        if out[i] < 0:
            out[i] = j
        if i == 0 and (open_ends or j == 0):
            return total, out
        d = i + j
        if d // segment != at:
            at, moves = d // segment, []
            before, earlier = kept[at]
            for k in range(at * segment, d + 1):
                now, move = wave(k, before, earlier)
                moves.append(move)
                before, earlier = now, before
        k = moves[d - at * segment][i]
        i, j = (i - 1, j) if k == 0 else (i, j - 1) if k == 1 else (i - 1, j - 1)


#: Moves (rows by diagonals, of all pairs) that are kept at once where many pairs are warped together.
MOVES = 4_000_000


def warp_paths(q: np.ndarray, rows: np.ndarray, ref: np.ndarray, qs: np.ndarray, rs: np.ndarray, band: float = np.inf, open_ends: bool = True, moves: int = MOVES) -> tuple[np.ndarray, np.ndarray]:
    """``warp_path`` of many rows of values at once, a diagonal of all of them as one step: costs, and columns (-1: infeasible or padding).

    ``q`` and ``qs`` are (pairs, times), padded behind each one's own ``rows``. Pairs that are too long to keep the moves of even one are warped alone.
    """
    pairs, n = q.shape
    size = moves // (n * (n + len(ref)))
    total, out = np.empty(pairs), np.full((pairs, n), -1, dtype=np.int64)
    if not size:
        for p, k in enumerate(rows):
            total[p], out[p, :k] = warp_path(q[p, :k], ref, qs[p, :k], rs, band, open_ends)
        return total, out
    for x in (slice(a, a + size) for a in range(0, pairs, size)):
        total[x], out[x] = _warp_together(q[x], rows[x], ref, qs[x], rs, band, open_ends)
    return total, out


def _warp_together(q: np.ndarray, rows: np.ndarray, ref: np.ndarray, qs: np.ndarray, rs: np.ndarray, band: float, open_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    (pairs, n), m = q.shape, len(ref)
    moves = np.zeros((n + m - 1, pairs, n), dtype=np.int8)
    last, end, one = np.full((pairs, m), np.inf), rows - 1, np.arange(pairs)
    before, earlier = np.full((pairs, n + 1), np.inf), np.full((pairs, n + 1), np.inf)  # row i at i + 1
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d) + 1
        j = d - np.arange(low, high)
        cost = (q[:, low:high] - ref[j]) ** 2
        if np.isfinite(band):
            cost[np.abs(qs[:, low:high] - rs[j]) > band] = np.inf
        best, kind = before[:, low:high], np.zeros(cost.shape, dtype=np.int8)
        for value, k in ((before[:, low + 1 : high + 1], 1), (earlier[:, low:high], 2)):
            less = value < best
            best = np.where(less, value, best)
            kind[less] = k
        if low == 0:
            best[:, 0] = 0.0 if open_ends or d == 0 else before[:, 1]
            kind[:, 0] = 0 if open_ends else 1
        now = np.full((pairs, n + 1), np.inf)
        now[:, low + 1 : high + 1] = best + cost
        moves[d, :, low:high] = kind
        ends = np.flatnonzero((end >= low) & (end < high))
        last[ends, d - end[ends]] = now[ends, end[ends] + 1]
        before, earlier = now, before
    j = last.argmin(axis=1) if open_ends else np.full(pairs, m - 1)
    total, out, i = last[one, j], np.full((pairs, n), -1, dtype=np.int64), end.copy()
    at = np.flatnonzero(np.isfinite(total))
    while len(at):
        new = at[out[at, i[at]] < 0]
        out[new, i[new]] = j[new]
        at = at[(i[at] > 0) | (False if open_ends else j[at] > 0)]
        k = moves[i[at] + j[at], at, i[at]]
        i[at] -= k != 1
        j[at] -= k != 0
    return total, out
