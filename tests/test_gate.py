"""The uniqueness gate: one product of rows and states, against its SQL and enumeration."""

from __future__ import annotations

import duckdb
import numpy as np
from conftest import SMALL, same_rows

from fieldtrace import catalog
from fieldtrace.operators import kernels


def test_best_and_rival_equal_enumeration():
    rng = np.random.default_rng(2)
    ll, dist = rng.integers(-4, 0, size=(200, 9)) + rng.choice([0.0, 1e-13], size=(200, 9)), np.arange(9.0)
    best, top, rival = kernels.best_and_rival(ll, dist, 5)
    for row, b, t, s in zip(ll, best, top, rival, strict=True):
        assert b == min(range(9), key=lambda i: (-round(row[i], 9), i)) and t == row.max()
        far = [row[i] for i in range(9) if abs(i - b) > 5]
        assert (s == max(far)) if far else np.isnan(s)


def test_gate_on_short_passes_agrees_with_its_sql(spark, tmp_path):
    # a map of six cells has none that is far from another: such rows have the least scale
    for k, most in enumerate((6, 9)):
        path = tmp_path / str(k)
        path.mkdir()
        duckdb.sql(f"copy (select * from '{SMALL}/events.parquet' qualify row_number() over (partition by user_id order by ts, event_id) <= {most}) to '{path}/events.parquet' (format parquet)")
        con = duckdb.connect()
        con.sql(f"create view events as select * from '{path}/events.parquet'")
        got = catalog.QUERIES["v2_uniqueness_gate"](spark, str(path))
        same_rows(got, con.sql(catalog.ORACLE_SQL["v2_uniqueness_gate"]))
        assert got.count() == 15 * most
        assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()  # scores of all states as nested arrays took 1.7 ms a row
