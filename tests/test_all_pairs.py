"""Queries on pairs over a table with copies of passes: a copy is a pass like any other, so every pair is a row."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL, same_rows

from fieldtrace import catalog


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    path = tmp_path_factory.mktemp("copied")
    duckdb.sql(f"copy (select event_id + k * 100000 as event_id, ts, user_id + k * 1500 as user_id, event_type, value, props from '{SMALL}/events.parquet', (select unnest(range(3)) as k)) to '{path}/events.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    return str(path), con


def rows_of(spark, copied, name):
    got = catalog.QUERIES[name](spark, copied[0])
    same_rows(got, copied[1].sql(catalog.ORACLE_SQL[name]))
    return got.collect()


def test_windows_of_copies_are_pairs(spark, copied):
    rows = rows_of(spark, copied, "c1_c2_c8_alike_windows")
    alone = catalog.QUERIES["c1_c2_c8_alike_windows"](spark, SMALL).count()
    # of three copies: a pair of different passes is nine pairs, and the windows of a pass pair with those of its copies
    copies = [r for r in rows if r.a % 1500 == r.b % 1500]
    assert len(rows) == 9 * alone + len(copies)
    assert len([r for r in copies if r.a_start == r.b_start]) == 3 * 15 * 33 and all(r.similarity == 1.0 for r in copies if r.a_start == r.b_start)


def test_passes_and_their_copies_are_pairs(spark, copied):
    rows = rows_of(spark, copied, "j11_c2_pairwise_similarity")
    assert len(rows) == 45 * 44 / 2
    copies = [r for r in rows if r.a % 1500 == r.b % 1500]
    assert len(copies) == 3 * 15 and all(r["corr"] == 1.0 for r in copies)


def test_passes_of_a_direction_and_their_copies_are_pairs(spark, copied):
    rows = rows_of(spark, copied, "j12_j13_direction_pairs")
    assert len(rows) == 3 * (15 * 14 / 2)
    copies = [r for r in rows if r.a % 1500 == r.b % 1500]
    assert len(copies) == 3 * 15 and all((r.plus, r.minus) == (0, 0) for r in copies)


def test_direction_pairs_make_no_sums(spark, copied):
    got = catalog.QUERIES["j12_j13_direction_pairs"](spark, copied[0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sab" not in plan  # five sums a pair that no column is read from
