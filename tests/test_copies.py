"""Queries on pairs over a table with copies of passes: pairs of classes and member rows, which give all pairs again."""

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


@pytest.mark.parametrize("name", ["j11_c2_pairwise_similarity", "j12_j13_direction_pairs", "c1_c2_c8_alike_windows"])
def test_pairs_of_classes_agree_with_sql(spark, copied, name):
    path, con = copied
    got = catalog.QUERIES[name](spark, path)
    same_rows(got, con.sql(catalog.ORACLE_SQL[name]))
    small = catalog.QUERIES[name](spark, SMALL)
    # copies add members, and no pairs of different passes
    assert got.where("kind = 'pair' and a <> b").count() == small.where("kind = 'pair' and a <> b").count() > 0
    assert got.where("kind = 'member'").count() > small.where("kind = 'member'").count()


def test_classes_of_windows_give_all_pairs_again(spark, copied):
    from fieldtrace.operators import windowpairs
    from fieldtrace.plans import tracks

    q, _ = tracks._windows(spark, copied[0])
    q = q.where("start < 6")
    want = {(r.a, r.a_start, r.b, r.b_start) for r in windowpairs.alike_windows(q, "pass", 2, 0.8).collect()}
    rows = windowpairs.alike_classes(q, "pass", 2, 0.8).collect()
    held = {(r["pass"], r.start): {r["pass"]} for r in q.collect()}
    for r in rows:
        if r.kind == "member":
            held[r.a, r.a_start].add(r.b)
    got = {(min((x, r.a_start), (y, r.b_start)) + max((x, r.a_start), (y, r.b_start))) for r in rows if r.kind == "pair" for x in held[r.a, r.a_start] for y in held[r.b, r.b_start] if x != y}
    firsts = {(r.a, r.a_start) for r in rows if r.kind == "member"}
    got |= {(x, s, y, s) for k, s in firsts for x in held[k, s] for y in held[k, s] if x < y}
    assert got == want and len(want) > 0
