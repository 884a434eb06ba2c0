from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def same_rows(df, relation) -> None:
    """The same columns and the same rows in any order."""
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    at = [relation.columns.index(n) for n in names]
    text = lambda v: repr(v) if isinstance(v, float) else str(v)
    got = sorted(tuple(text(r[n]) for n in names) for r in df.collect())
    want = sorted(tuple(text(r[i]) for i in at) for r in relation.fetchall())
    assert got == want
