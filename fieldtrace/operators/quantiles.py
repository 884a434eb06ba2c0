"""Exact weighted medians by histogram descent.

The values of a cell are counted in bins of equal width between their least and greatest; the bin where half of the weight is
reached is taken up again as a range of its own, and at the end only its different values are sorted. Counts by bin are combined
before the shuffle, so a cell with most of all rows is no more work for one task than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c

#: Bins of a histogram, and how often the bin that holds the median is split again.
BINS, ROUNDS = 1024, 2


def weighted_median(df: DataFrame, keys: list[str], v: str, weight: str, out: str = "wmedian", bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """Smallest value of each key at which the running weight reaches half of the total; missing values, NaN and weights <= 0 drop out.

    The same result as sorting every key's values. Null keys are a key of their own. A key's table of bins has ``bins`` rows at most.
    """
    held = {k: f"_key_{i}" for i, k in enumerate(keys)}
    rows = df.where(c(v).isNotNull() & ~F.isnan(c(v).cast("double")) & (c(weight) > 0)).select(*[F.col(k).alias(n) for k, n in held.items()], c(v).alias("_v"), c(weight).alias("_w"))
    names = list(held.values())
    # of each key the range in which the median lies, the weight before it, and the weight in all
    range_ = rows.groupBy(*names).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_w").alias("_total")).withColumn("_before", F.lit(0).cast(_sum_type(rows)))
    for _ in range(rounds):
        range_ = _split(_inside(rows, range_, names), names, bins)
    left = _inside(rows, range_, names).groupBy(*names, "_v", "_before", "_total").agg(F.sum("_w").alias("_w"))
    run = F.col("_before") + F.sum("_w").over(Window.partitionBy(*names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    got = left.withColumn("_run", run).where(F.col("_run") >= 0.5 * F.col("_total")).groupBy(*names).agg(F.min("_v").alias(out))
    return got.withColumnsRenamed({n: k for k, n in held.items()})


def _sum_type(rows: DataFrame) -> str:
    return "double" if dict(rows.dtypes)["_w"] in ("double", "float") else "long" if dict(rows.dtypes)["_w"] in ("tinyint", "smallint", "int", "bigint") else dict(rows.agg(F.sum("_w").alias("s")).dtypes)["s"]


def _inside(rows: DataFrame, range_: DataFrame, names: list[str]) -> DataFrame:
    """Rows in the range of their key."""
    other = range_.withColumnsRenamed({n: f"{n}_" for n in names})
    same: list[Column] = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    return rows.join(other, same).drop(*[f"{n}_" for n in names]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _split(rows: DataFrame, names: list[str], bins: int) -> DataFrame:
    """The bin of each key's range in which half of the weight is reached, as the new range."""
    width = (F.col("_hi") - F.col("_lo")).cast("double")
    # one rounding rule for all values of a key: a greater value never lands in a smaller bin
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")).cast("double") / width * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(*names, bin_.alias("_bin"), "_before", "_total").agg(F.sum("_w").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_run", F.col("_before") + F.sum("_w").over(w))
    first = run.where(F.col("_run") >= 0.5 * F.col("_total")).groupBy(*names).agg(F.min_by(F.struct("_lo", "_hi", "_total", (F.col("_run") - F.col("_w")).alias("_before")), "_bin").alias("_b"))
    return first.select(*names, "_b.*")
