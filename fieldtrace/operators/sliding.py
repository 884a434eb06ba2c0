"""Sliding sums of products: a kernel laid on every place of a row of values, for short kernels as one matrix product, for long
ones by FFT over overlapping stretches (overlap-save), so that all places of n values cost n log n."""

from __future__ import annotations

import numpy as np

#: Kernels up to so long are laid on directly.
DIRECT = 64
#: Values of work arrays.
WORK = 1 << 22


def products(values: np.ndarray, kernels: np.ndarray) -> np.ndarray:
    """For each kernel (row) and each place s with a whole kernel ahead of it the sum of kernel[i] * values[s + i]."""
    n, m = len(values), kernels.shape[1]
    if n < m or not len(kernels):
        return np.zeros((len(kernels), max(0, n - m + 1)))
    if m <= DIRECT:
        return np.ascontiguousarray(kernels) @ np.lib.stride_tricks.sliding_window_view(values, m).T
    size = 1 << int(np.ceil(np.log2(min(n, 8 * m) + m)))  # of a stretch: whole values, or eight kernels
    step, places = size - m + 1, n - m + 1
    out = np.empty((len(kernels), places))
    rows = max(1, WORK // size)
    # a stretch that begins at s gives the places s .. s + step - 1
    stretches = [np.fft.rfft(values[s : s + size], size) for s in range(0, places, step)]
    for k in range(0, len(kernels), rows):
        turned = np.conj(np.fft.rfft(kernels[k : k + rows], size, axis=1))
        for i, stretch in enumerate(stretches):
            got = np.fft.irfft(stretch * turned, size, axis=1)
            s = i * step
            out[k : k + rows, s : s + step] = got[:, : min(step, places - s)]
    return out


def running(values: np.ndarray, m: int) -> np.ndarray:
    """Sums of m values from every place on."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[m:] - total[: len(total) - m]


class Windows:
    """All windows of ``n`` cells of a row of values (NaN: missing), standardised by the mean and deviation of the values there are.

    A window counts if it begins with a value, ``share`` of its cells have one, and it is not flat; missing cells are zero.
    """

    def __init__(self, values: np.ndarray, n: int, share: float = 1.0, flat: float = 1e-9) -> None:
        self.n = n
        self.mask = np.isfinite(values)
        centre = values[self.mask].mean() if self.mask.any() else 0.0
        self.values = np.where(self.mask, values - centre, 0.0)
        self.count = running(self.mask.astype(np.float64), n)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.mean = running(self.values, n) / self.count
            # squares about a nearby value, block by block, so that running sums keep their digits
            self.deviation = np.sqrt(np.maximum(running(self.values**2, n) / self.count - self.mean**2, 0.0))
        self.good = self.mask[: len(self.count)] & (self.count >= share * n) & (self.count > 0)
        for s in np.flatnonzero(self.good & (self.deviation < 1e-4 * max(1.0, float(np.abs(self.values).max(initial=0.0))))):
            own = self.values[s : s + n][self.mask[s : s + n]]
            self.mean[s], self.deviation[s] = own.mean(), own.std()
        self.good &= self.deviation >= flat

    def at(self, starts: np.ndarray) -> np.ndarray:
        """The standardised windows that begin at ``starts``, as rows."""
        cells = starts[:, None] + np.arange(self.n)
        return np.where(self.mask[cells], (self.values[cells] - self.mean[starts, None]) / self.deviation[starts, None], 0.0)

    def scores(self, windows: np.ndarray, mode: str) -> np.ndarray:
        """Of each standardised window (row) against all windows of this row: correlation ('ncc') or negative mean squared difference ('msd')."""
        dot = products(self.values, windows)
        if not self.mask.all():
            dot -= self.mean * products(self.mask.astype(np.float64), windows)
        else:
            dot -= self.mean * windows.sum(axis=1)[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            dot /= self.deviation
        if mode == "ncc":
            return dot / self.n
        return (2 * dot - (windows**2).sum(axis=1)[:, None] - self.count) / self.n


def laid_correlations(reference: np.ndarray, q: np.ndarray, places: np.ndarray, starts: np.ndarray, least: int, flat: float = 1e-12) -> np.ndarray:
    """Correlation of ``q`` with the reference laid at ``start + places`` (fractional: between cells by a line) for each start.

    Values outside the reference, or beside one of its gaps (NaN), do not count; NaN with fewer than ``least`` values or a flat side.
    """
    ok = np.isfinite(q) & np.isfinite(places)
    q, places = q[ok], places[ok]
    out = np.full(len(starts), np.nan)
    if not len(q) or not len(reference):
        return out
    whole = np.floor(places).astype(np.int64)
    part = places - whole
    low, span = int(whole.min()), int(whole.max() - whole.min()) + 1
    # cells from the first start's lowest place to the last start's highest, and one more
    first, last = int(starts.min()) + low, int(starts.max()) + low + span
    cells = np.arange(first, last + 1)
    inside = (cells >= 0) & (cells < len(reference))
    r = np.where(inside, reference[np.clip(cells, 0, len(reference) - 1)], np.nan)
    have = np.isfinite(r)
    centre = r[have].mean() if have.any() else 0.0
    r = np.where(have, r - centre, 0.0)
    q = q - q.mean()
    on, off = part == 0, part > 0
    pair = np.append(have[:-1] & have[1:], False).astype(np.float64)
    nxt = np.append(r[1:], 0.0)
    one = have.astype(np.float64)

    def kernel(which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.bincount(whole[which] - low, weights=weight[which], minlength=span)

    def total(values: np.ndarray, *kernels: np.ndarray) -> np.ndarray:
        return products(values, np.stack(kernels))[:, starts - int(starts.min())]

    ones, rest = np.ones(len(q)), 1 - part
    n, sq, sqq = total(one, kernel(on, ones), kernel(on, q), kernel(on, q * q)) + total(pair, kernel(off, ones), kernel(off, q), kernel(off, q * q))
    x_on = total(r * one, kernel(on, ones), kernel(on, q))
    x_low, x_high = total(r * pair, kernel(off, rest), kernel(off, rest * q)), total(nxt * pair, kernel(off, part), kernel(off, part * q))
    sx, sxq = x_on + x_low + x_high
    sxx = (total(r * r * one, kernel(on, ones)) + total(r * r * pair, kernel(off, rest * rest)) + total(nxt * nxt * pair, kernel(off, part * part)) + total(r * nxt * pair, kernel(off, 2 * rest * part)))[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        vq, vx, both = sqq - sq * sq / n, sxx - sx * sx / n, sxq - sq * sx / n
        # sums of squares carry a rounding error of their own size
        good = (n >= least - 0.5) & (n > 0) & (vq > np.maximum(flat, 1e-13 * sqq)) & (vx > np.maximum(flat, 1e-13 * sxx))
        out[good] = (both / np.sqrt(vq * vx))[good]
    return out
