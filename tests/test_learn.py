"""Boosted trees of all folds at once against fitting every fold alone."""

from __future__ import annotations

import numpy as np
import pytest

from fieldtrace.operators import learn


def alone(x: np.ndarray, y: np.ndarray, train: np.ndarray, cuts: list[np.ndarray], trees: int, depth: int, bins: int, rate: float, least: int, l2: float) -> np.ndarray:
    """Margins of all rows from trees fitted on ``train``, node by node."""
    b = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    total = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, out = y - p, p * (1 - p), np.zeros(len(x))

        def grow(rows: np.ndarray, level: int, g=g, h=h, out=out) -> None:
            fit = rows[train[rows]]
            best = (1e-9, None)
            if level < depth:
                for i in range(x.shape[1]):
                    for cut in range(bins):
                        lo, hi = fit[b[fit, i] <= cut], fit[b[fit, i] > cut]
                        if len(lo) >= least and len(hi) >= least:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (lo, hi)) - g[fit].sum() ** 2 / (h[fit].sum() + l2)
                            if gain > best[0] + 1e-12:
                                best = (gain, (i, cut))
            if best[1] is None:
                out[rows] = g[fit].sum() / (h[fit].sum() + l2)
            else:
                i, cut = best[1]
                grow(rows[b[rows, i] <= cut], level + 1)
                grow(rows[b[rows, i] > cut], level + 1)

        grow(np.arange(len(x)), 0)
        total = total + rate * out
    return total


def test_all_folds_at_once_equal_each_fold_alone(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3) > 0).astype(int)
    seg = rng.choice(["a", "b", "c", "d"], n)
    rows = [(i, str(s), int(t), *map(float, v)) for i, (s, t, v) in enumerate(zip(seg, y, x, strict=True))]
    df = spark.createDataFrame(rows, "id int, seg string, y int, f0 double, f1 double, f2 double").repartition(4)
    kw = {"trees": 3, "depth": 2, "bins": 8, "rate": 0.3, "least": 8, "l2": 1.0}
    got = {r.id: r.prob for r in learn.leave_one_out_trees(df, "seg", "y", ["f0", "f1", "f2"], **kw).collect()}
    shares = [i / 8 for i in range(1, 8)]
    cuts = [np.unique(np.quantile(x[:, i], shares, method="inverted_cdf")) for i in range(3)]
    for s in "abcd":
        total = alone(x, y.astype(float), seg != s, cuts, **kw)
        for i in np.flatnonzero(seg == s):
            assert got[int(i)] == pytest.approx(1 / (1 + np.exp(-total[i])), abs=1e-9)
    right = np.mean([(got[i] > 0.5) == bool(y[i]) for i in range(n)])
    assert right > 0.75


def test_folds_of_one_class_nulls_and_clashing_columns(spark):
    rows = [(1, "a", 1, 2.0, "p")] * 20 + [(2, "b", 0, None, "q")] * 20 + [(3, None, None, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, seg string, y int, f double, x0 string")
    got = {r.id: r.prob for r in learn.leave_one_out_trees(df, "seg", "y", ["f"], trees=2).collect()}
    assert got[1] is None and got[2] is None and 0 < got[3] < 1  # without a only 0 is left, without b only 1
    assert learn.leave_one_out_trees(df.where("id > 9"), "seg", "y", ["f"], trees=1).count() == 0


def test_a_forest_does_not_depend_on_the_parts_of_its_input(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "abc"[i % 3], int(x + rng.normal() * 0.3 > 0), float(x)) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "id int, seg string, y int, f double")
    got = []
    for n in (1, 7):
        out, auc = learn.leave_one_out_forest(df.repartition(n, "id"), ["a", "b", "c"], "seg", "y", ["f"], trees=5, depth=2)
        got.append({r.id: r.prob for r in out.collect()})
    assert got[0] == got[1] and len(got[0]) == 600 and auc > 0.8


def test_a_tree_on_cells_splits_where_enumeration_does():
    rng = np.random.default_rng(4)
    bins, bag, weight = rng.integers(0, 6, size=(80, 1)), rng.poisson(3, 80), np.array([0.7, 1.9])
    y = (rng.random(80) < 0.2 + 0.1 * bins[:, 0]).astype(int)

    def grow(own: np.ndarray, level: int, out: np.ndarray) -> None:
        of = lambda rows: np.bincount(y[rows], weights=bag[rows], minlength=2)
        gini = lambda h: (h * weight).sum() * (1 - (((h * weight) / (h * weight).sum()) ** 2).sum())
        best = (1e-9, None)
        for cut in range(6) if level < 2 else ():
            lo, hi = own[bins[own, 0] <= cut], own[bins[own, 0] > cut]
            if bag[lo].sum() >= 8 and bag[hi].sum() >= 8:
                best = max(best, (gini(of(own)) - gini(of(lo)) - gini(of(hi)), -cut), key=lambda x: x[0])
        if best[1] is None:
            out[own] = (of(own) * weight)[1] / (of(own) * weight).sum()
        else:
            grow(own[bins[own, 0] <= -best[1]], level + 1, out)
            grow(own[bins[own, 0] > -best[1]], level + 1, out)

    want = np.zeros(80)
    grow(np.arange(80), 0, want)
    assert learn.forest_tree(bins, y, bag, weight, 2, 8, rng) == pytest.approx(want) and len(set(want)) > 2


def test_a_forest_on_cells_is_like_one_on_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 2))
    rows = [(i, "abc"[i % 3], int(a + b * b + rng.normal() * 0.5 > 0.8), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, seg string, y int, f double, g double")
    got = []
    for most in (learn.MOST_CELLS, 0):  # no cell allowed: Spark's forests
        out, auc = learn.leave_one_out_forest(df, ["a", "b", "c"], "seg", "y", ["f", "g"], trees=40, most_cells=most)
        got.append((np.array([r.prob for r in out.orderBy("id").collect()]), auc))
    assert len(got[0][0]) == len(got[1][0]) == 1500
    assert np.abs(got[0][0] - got[1][0]).mean() < 0.05 and got[0][1] == pytest.approx(got[1][1], abs=0.02) and got[0][1] > 0.8


def test_rows_that_are_alike_are_one_cell(spark):
    """Ten times the rows are ten times the counts: the trees are grown on as many cells, and every row is scored."""
    df = spark.range(300).selectExpr("id", "substr('abc', cast(id % 3 + 1 AS int), 1) AS seg", "cast(id % 7 > 2 AS int) AS y", "cast(id % 11 AS double) AS f")
    many = df.crossJoin(spark.range(10).toDF("k"))
    out, _ = learn.leave_one_out_forest(many, ["a", "b"], "seg", "y", ["f"], trees=3, most_cells=66)
    assert "rawPrediction" not in out._jdf.queryExecution().analyzed().toString() and out.where("prob between 0 and 1").count() == 2000
