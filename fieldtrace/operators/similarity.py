"""Similarity of passes and windows: correlation, bias-removed errors, lags, sliding windows, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import windows as windows_
from ..functions.scalars import c
from . import matching


def pair_metrics(a: Column | str, b: Column | str, least: int = 3) -> list[Column]:
    """Count, correlation, RMS, bias (median difference) and bias-free RMS and MAE need two passes; see ``unbiased``."""
    d = c(a) - c(b)
    return [F.count(d).alias("n"), F.when(F.count(d) >= least, F.corr(a, b)).alias("corr"), F.sqrt(F.avg(d * d)).alias("rms"), F.percentile(d, F.lit(0.5)).alias("bias")]


def unbiased(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key: n, corr, rms, bias and the errors after the median difference is taken out."""
    w = Window.partitionBy(keys)
    rows = df.withColumn("_d", c(a) - c(b)).withColumn("_u", F.col("_d") - F.percentile("_d", F.lit(0.5)).over(w))
    return rows.groupBy(*keys).agg(*pair_metrics(a, b), F.sqrt(F.avg(F.col("_u") ** 2)).alias("rms_unbiased"), F.avg(F.abs("_u")).alias("mae_unbiased"))


def best_lag(a: DataFrame, b: DataFrame, keys: list[str], cell: str, va: str, vb: str, most: int, least: int) -> DataFrame:
    """Lag in cells (the map ``b`` at cell + lag) of each pass's greatest correlation over -most..most; the first of equal ones.

    The map is one track's cells, counted before every task gets it; all lags of a pass are scored at once.
    """
    rows = matching.pass_arrays(a, keys, cell, va).withColumnRenamed("c", "rel")
    ref = b.where(c(vb).isNotNull()).select(c(cell).alias("cell"), c(vb).alias("v"))
    tried = matching.search_starts(rows, ref, keys, [1.0], 1, share=0.0, lags=(-most, most), least=least)
    best = tried.select(*keys, F.array_max(F.transform("tries", lambda t: F.struct(t["score"].alias("corr"), (-t["s"]).alias("k")))).alias("m")).where("m is not null")
    return best.select(*keys, (-F.col("m.k")).alias("lag"), F.col("m.corr").alias("corr"))


def windows(df: DataFrame, keys: list[str], cell: str, value: str, n: int) -> DataFrame:
    """Every complete window of ``n`` consecutive cells, standardised: keys, start, w array<double>."""
    w = Window.partitionBy(keys).orderBy(cell).rowsBetween(0, n - 1)
    rows = df.where(c(value).isNotNull()).select(*keys, c(cell).alias("start"), F.collect_list(value).over(w).alias("w"), F.max(cell).over(w).alias("_last"))
    rows = rows.where((F.size("w") == n) & (F.col("_last") - F.col("start") == n - 1))
    mean = F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / n
    rows = rows.withColumn("_m", mean).withColumn("_sd", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) ** 2) / n))
    return rows.where("_sd >= 1e-9").select(*keys, "start", F.transform("w", lambda x: (x - F.col("_m")) / F.col("_sd")).alias("w"))


def window_match(grid: DataFrame, reference: DataFrame, keys: list[str], cell: str, value: str, n: int, zone: int, stride: int = 1) -> DataFrame:
    """Normalised cross-correlation of every ``stride``-th window of each pass with every window of the map (cell, v): best start (first
    of equal ones), score, runner-up at ``zone`` or further."""
    one = grid.select(*keys, F.lit("v").alias("f"), c(cell).alias("cell"), c(value).alias("v"))
    scores = matching.window_scores(one, reference.select(F.lit("v").alias("f"), "cell", "v"), keys, n, stride, {"scores": (["v"], "ncc")})
    return matching.best_of(scores, [*keys, "start"], zone)


def shift_msd(query: DataFrame, reference: DataFrame, key: str, cell: str, q: str, v: str, offsets: list[int], least: int) -> DataFrame:
    """Mean squared difference of standardised query and reference for each offset; per key the first least one."""
    listed = query.select(key, F.col(q).alias("_q"), c(cell).alias("_c"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    pairs = listed.withColumn(cell, F.col("_c") + F.col("offset")).join(reference.select(cell, F.col(v).alias("_v")), cell)
    w = Window.partitionBy(key, "offset")
    z = lambda x: (c(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w)
    scored = pairs.withColumn("_d", (z("_q") - z("_v")) ** 2).groupBy(key, "offset").agg(F.count("*").alias("n"), F.avg("_d").alias("msd")).where(F.col("n") >= least)
    best = scored.where("msd is not null").groupBy(key).agg(F.min(F.struct("msd", "offset")).alias("m"))
    return best.select(key, F.col("m.offset").alias("offset"), F.col("m.msd").alias("msd"))


def gated_correlations(df: DataFrame, key: str, a: str, b: str, least: int, share: float) -> DataFrame:
    """Per key the pairs with both values, the correlation given max(``least``, ``share``) of them, and that of the robust z-scores given ``share``."""
    w = Window.partitionBy(key)
    rows = df.withColumn("_k", F.count("*").over(w)).where(c(a).isNotNull() & c(b).isNotNull())
    rows = stats.robust_z(stats.robust_z(rows, [key], a, "_za"), [key], b, "_zb")
    n, k = F.count("*"), F.first("_k")
    return rows.groupBy(key).agg(n.alias("n"), F.when(n >= F.greatest(F.lit(float(least)), share * k), F.corr(a, b)).alias("ncc"), F.when(n >= share * k, F.corr("_za", "_zb")).alias("robust"))


def cross_date(first: DataFrame, second: DataFrame, keys: list[str], cell: str, v: str, step: float) -> DataFrame:
    """Two days' maps joined on the cell -> keys, n, corr, derivative_corr (of the gradients), rms_unbiased."""
    o = Window.partitionBy(keys).orderBy(cell)
    side = lambda df, x: df.select(*keys, cell, c(v).alias(f"_{x}"), windows_.gradient(v, c(cell) * step, o).alias(f"_g{x}"))
    rows = side(first, "a").join(side(second, "b"), [*keys, cell])
    rows = rows.withColumn("_u", F.col("_a") - F.col("_b") - F.percentile(F.col("_a") - F.col("_b"), F.lit(0.5)).over(Window.partitionBy(keys)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("corr"), F.corr("_ga", "_gb").alias("derivative_corr"), F.sqrt(F.avg(F.col("_u") ** 2)).alias("rms_unbiased"))
