"""Registry of queries and the SQL that each must agree with, and the tables that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import by_pass

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its own or the given name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(sql: str, digits: int = 6) -> str:
    """The SQL twin of det_round."""
    return f"floor(({sql}) * 1e{digits} + 0.5) / 1e{digits}"


#: Events as passes: one pass per user, rows numbered in time; g is v with gaps, t the seconds since the pass began.
SERIES = """s AS (SELECT user_id AS pass, event_id, event_type, ts, value AS v,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 IN (1, 2) THEN NULL ELSE value END AS g,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t FROM events)"""


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_pass("pass", ["ts", "event_id"])
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pass"), "event_id", "event_type", "ts", F.col("value").alias("v"),
        F.when((F.col("event_id") % 5 == 0) | (F.col("event_id") % 7).isin(1, 2), None).otherwise(F.col("value")).alias("g"),
    )
    rows = rows.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    return rows.withColumn("t", (micros("ts") - F.min(micros("ts")).over(Window.partitionBy("pass"))) / 1e6)


#: The same passes on a grid of 48 cells (cell = idx modulo 48, mean value), the shape of a multi-pass map.
GRID = """m AS (SELECT pass, idx % 48 AS cell, avg(v) AS v, count(*) AS n FROM s GROUP BY ALL)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("pass", (F.col("idx") % 48).alias("cell")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
