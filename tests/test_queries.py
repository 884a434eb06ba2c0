"""Every signal-map query against its SQL, or a row count where SQL has no form for it."""

from __future__ import annotations

import pytest
from conftest import SMALL, same_rows

from fieldtrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"l1_l3_reliability_forest"}))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL).collect()
    assert (len(rows) == 0) == (name == "s17_optional_source")


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["pass", "bins", "mean_z", "p90_z", "rmse"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_wide_window_pushes_columns_to_the_scan(spark):
    plan = catalog.QUERIES["a1_coverage_table"](spark, SMALL)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan


def test_tracks_are_named_for_what_they_run():
    assert "viterbi_tracks" in catalog.QUERIES and "v3_v25_tracks" not in catalog.QUERIES


def test_queries_run_with_the_operators_default_sizes(spark, monkeypatch):
    from fieldtrace.operators import learn
    from fieldtrace.plans import tracks

    assert not {"particles", "k"} & {key for c in tracks.CONFIGS.values() for key in c}
    seen = {}
    monkeypatch.setattr(learn, "leave_one_out_forest", lambda df, *a, **kw: (seen.update(kw), (df.withColumn("prob", df["margin"] * 0), 0.0))[1])
    catalog.QUERIES["l1_l3_reliability_forest"](spark, SMALL)
    assert "trees" not in seen
