"""Resampling of passes: fixed periods, uniform thinning, irregular passes onto a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_pass


def resample_median(df: DataFrame, keys: list[str], ts: str, values: list[str], period_s: int, dense: bool = True, count: str | None = None) -> DataFrame:
    """Medians of ``values`` by periods counted from midnight (periods that divide a day). -> keys, bin_s (epoch seconds), values.

    ``dense`` lists empty periods between a key's first and last as nulls.
    """
    seconds = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (period_s * 1000000)).cast("long") * period_s
    aggs = [F.percentile(v, F.lit(0.5)).alias(v) for v in values] + ([F.count("*").alias(count)] if count else [])
    bins = df.groupBy(*keys, seconds.alias("bin_s")).agg(*aggs)
    if not dense:
        return bins
    span = bins.groupBy(*keys).agg(F.min("bin_s").alias("lo"), F.max("bin_s").alias("hi"))
    every = span.select(*keys, F.explode(F.sequence("lo", "hi", F.lit(period_s).cast("long"))).alias("bin_s"))
    out = every.join(bins, [*keys, "bin_s"], "left")
    return out.withColumn(count, F.coalesce(count, F.lit(0).cast("long"))) if count else out


def thin(df: DataFrame, keys: list[str], row: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced by row number (0-based), half-way positions to the even row."""
    sizes = df.groupBy(*keys).agg((F.max(row) + 1).alias("_n"))
    k = F.least(F.col("_n"), F.lit(most))
    spots = sizes.select(*keys, F.col("_n"), k.alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1)).alias("_i"))
    at = F.when(F.col("_k") > 1, F.bround(F.col("_i") * (F.col("_n") - 1) / (F.col("_k") - 1).cast("double"), 0)).otherwise(0).cast("long")
    return df.join(spots.select(*keys, at.alias(row)).distinct(), [*keys, row], "left_semi")


def to_grid(df: DataFrame, key: str, coordinate: str, value: str, step: float, low: int, high: int) -> DataFrame:
    """Pass rows onto cells ``low..high`` of ``step``: equal coordinates collapse to their median, then linear between neighbours, null outside the pass's range."""
    from ..functions.windows import asof_linear

    own = df.where(F.col(value).isNotNull()).groupBy(key, coordinate).agg(F.percentile(value, F.lit(0.5)).alias(value)).withColumn("_q", F.lit(False)).withColumn("cell", F.lit(None).cast("long"))
    cells = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("cell"))
    asked = cells.select(key, (F.col("cell") * step).alias(coordinate), F.lit(None).cast("double").alias(value), F.lit(True).alias("_q"), "cell")
    return asof_linear(own.unionByName(asked), key, coordinate, [value], "_q", clamp=False).select(key, "cell", value)


def number_rows(df: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(by_pass(key, order)) - 1).cast("long"))
