"""Totals of points in ranges, from running sums over blocks."""

from __future__ import annotations

import pytest

from fieldtrace.operators import series


@pytest.mark.parametrize("rows", [65_536, 10])
def test_range_totals_equal_brute_force(spark, rows):
    points = [(float(i * 7 % 50), i % 11 - 4.75) for i in range(300)] + [(None, 1.0), (3.0, None)]
    spans = [(k, float(k % 13 * 3), float(k % 13 * 3 + k % 7)) for k in range(60)] + [(99, 5.0, 1.0), (98, None, 4.0), (97, 70.0, 80.0)]
    got = series.range_totals(spark.createDataFrame(points, "t double, v double"), "t", "v", spark.createDataFrame(spans, "k long, a double, b double"), "k", "a", "b", rows).collect()
    want = {k: [v for t, v in points if t is not None and v is not None and a <= t <= b] for k, a, b in spans if a is not None}
    assert {r.k: (r.n, float(r.total)) for r in got} == {k: (len(v), sum(v)) for k, v in want.items() if v}
