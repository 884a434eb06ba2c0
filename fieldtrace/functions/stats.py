"""Aggregate expressions and robust normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import c

MAD_SCALE = 1.4826


def median(v: Column | str) -> Column:
    return F.percentile(c(v), F.lit(0.5))


def rmse(v: Column | str) -> Column:
    return F.sqrt(F.avg(c(v) * c(v)))


def max_abs(v: Column | str) -> Column:
    return F.max(F.abs(c(v)))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def with_mad(df: DataFrame, keys: list[str], v: str, med: str = "med", mad: str = "mad") -> DataFrame:
    """Adds the group's median and median absolute deviation to every row."""
    w = Window.partitionBy(keys)
    return df.withColumn(med, median(v).over(w)).withColumn(mad, F.percentile(F.abs(c(v) - c(med)), F.lit(0.5)).over(w))


def z_score(v: Column | str, w, least: float = 1e-9) -> Column:
    sd = F.stddev_pop(c(v)).over(w)
    return F.when(sd >= least, (c(v) - F.avg(c(v)).over(w)) / sd)


def robust_z(df: DataFrame, keys: list[str], v: str, out: str = "z", clip: float | None = 6.0, least: float = 1e-6) -> DataFrame:
    """(v - median) / (1.4826 MAD); a MAD below ``least`` gives way to the population deviation, that to 1."""
    w = Window.partitionBy(keys)
    df = with_mad(df, keys, v, "_med", "_mad").withColumn("_sd", F.stddev_pop(c(v)).over(w))
    scale = F.when(F.col("_mad") * MAD_SCALE >= least, F.col("_mad") * MAD_SCALE).when(F.col("_sd") >= least, F.col("_sd")).otherwise(1.0)
    z = (c(v) - F.col("_med")) / scale
    if clip is not None:
        z = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))
    return df.withColumn(out, z).drop("_med", "_mad", "_sd")


def weighted_median(df: DataFrame, keys: list[str], v: str, weight: str, out: str = "wmedian") -> DataFrame:
    """Smallest value at which the running weight reaches half of the total; missing values and weights <= 0 drop out."""
    rows = df.where(c(v).isNotNull() & (c(weight) > 0))
    # equal values share a place, so ties cannot change the answer; partial sums run before the window
    rows = rows.groupBy(*keys, v).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(Window.partitionBy(keys).orderBy(v))
    total = F.sum("_w").over(Window.partitionBy(keys))
    return rows.withColumn("_ok", run >= 0.5 * total).where("_ok").groupBy(*keys).agg(F.min(v).alias(out))


def robust_or_plain_z(df: DataFrame, keys: list[str], v: str, out: str = "z", least: float = 1e-9) -> DataFrame:
    """(v - median) / (1.4826 MAD) without a clip; where that is below ``least`` the z-score by mean and deviation, and 0 for a flat group."""
    w = Window.partitionBy(keys)
    rows = with_mad(df, keys, v, "_med", "_mad").withColumn("_sd", F.stddev_pop(c(v)).over(w)).withColumn("_mu", F.avg(c(v)).over(w))
    scale = F.col("_mad") * MAD_SCALE
    z = F.when(scale >= least, (c(v) - F.col("_med")) / scale).when(F.col("_sd") >= least, (c(v) - F.col("_mu")) / F.col("_sd")).otherwise(0.0)
    return rows.withColumn(out, z).drop("_med", "_mad", "_sd", "_mu")
