"""Evaluation of trajectories and results: metrics, gating sweeps, summaries, selection of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import c, progress_compat


def error_metrics(err: Column | str, idx: str = "idx", total: Column | None = None) -> list[Column]:
    """The metric columns of a trajectory's signed errors; the final error is that of the last row."""
    e = c(err)
    a = F.abs(e)
    out = [
        F.count(e).alias("sample_count"), F.avg(e).alias("mean_error"), stats.median(a).alias("median_abs"), F.avg(a).alias("mean_abs"), stats.rmse(e).alias("rmse"),
        F.percentile(a, F.lit(0.75)).alias("p75"), F.percentile(a, F.lit(0.9)).alias("p90"), F.max_by(a, idx).alias("final_abs"),
    ]
    return out + ([(F.count(e) / total).alias("coverage")] if total is not None else [])


def within(err: Column | str, *metres: float) -> list[Column]:
    return [stats.share(F.abs(c(err)) <= m).alias(f"within_{m:g}") for m in metres]


def trim_stop(df: DataFrame, key: str, position: str, idx: str, reverse: float, rows_left: int) -> DataFrame:
    """Per pass the row at which a reversal tail begins: the extremum in travel direction, if the pass then turns back more than ``reverse`` with at least ``rows_left`` rows left; else the end."""
    span = df.groupBy(key).agg(F.min_by(position, idx).alias("p0"), F.max_by(position, idx).alias("p1"), F.max(idx).alias("last"))
    way = F.when(F.col("p1") >= F.col("p0"), 1).otherwise(-1)
    rows = df.join(span, key).withColumn("_s", c(position) * way)
    top = rows.groupBy(key).agg(F.max(F.struct("_s", (-c(idx)).alias("i"))).alias("m"), F.max_by("_s", idx).alias("end"), F.first("last").alias("last"))
    at = -F.col("m.i")
    turned = (F.col("m._s") - F.col("end") > reverse) & (F.col("last") - at >= rows_left)
    return top.select(key, F.when(turned, at).otherwise(F.col("last")).cast("long").alias("stop"))


def gate_sweep(df: DataFrame, keys: list[str], margin: str, err: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: rows with at least that margin, their share, and error metrics; one pass over the table, one row per threshold exploded from conditional aggregates."""
    aggs = []
    for i, t in enumerate(thresholds):
        e = F.when(c(margin) >= t, F.abs(c(err)))
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), F.count(e).alias("accepted"), (F.count(e) / F.count("*")).alias("coverage"), stats.median(e).alias("median_abs"), F.percentile(e, F.lit(0.9)).alias("p90"), stats.rmse(e).alias("rmse")).alias(f"_{i}"))
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return out.select(*keys, F.explode(F.array(*[f"_{i}" for i in range(len(thresholds))])).alias("g")).select(*keys, "g.*")


def explode_membership(df: DataFrame, sets: dict[str, Column], name: str = "subset") -> DataFrame:
    """Rows repeated once for each (overlapping) subset that they belong to."""
    labels = F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in sets.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(labels))


def choose_total(df: DataFrame, key: str, compat: str = "compat", margin: str = "margin", vmax: str = "vmax", compat_window: float = 0.04, margin_window: float = 0.20) -> DataFrame:
    """The candidate of each key: near the best compatibility, then near the greatest margin among those, then the largest vmax."""
    w = Window.partitionBy(key)
    near = df.withColumn("_b", F.min(compat).over(w)).where(c(compat) <= F.col("_b") + compat_window)
    near = near.withColumn("_m", F.max(margin).over(w)).where(c(margin) >= F.col("_m") - margin_window)
    return near.withColumn("_r", F.row_number().over(w.orderBy(c(vmax).desc(), c(compat), "method"))).where("_r = 1").drop("_b", "_m", "_r")


def select_progress_margin(totals: DataFrame, axes: DataFrame, key: str, axis_margin: float = 5.0, advantage: float = 0.04) -> DataFrame:
    """Total candidate by ``choose_total``, replaced by the axis candidate where that is confident and fits the progress clearly better."""
    t = choose_total(totals, key).select(key, F.col("method").alias("total_method"), F.col("compat").alias("total_compat"))
    a = axes.select(key, F.col("method").alias("axis_method"), F.col("compat").alias("axis_compat"), F.col("margin").alias("axis_margin"))
    use_axis = (F.col("axis_margin") >= axis_margin) & (F.col("axis_compat") + advantage < F.col("total_compat"))
    joined = t.join(a, key, "left").withColumn("source", F.when(F.coalesce(use_axis, F.lit(False)), "axis").otherwise("total"))
    return joined.withColumn("selected", F.when(F.col("source") == "axis", F.col("axis_method")).otherwise(F.col("total_method")))


def progress(df: DataFrame, keys: list[str], position: str, order: str) -> DataFrame:
    """Absolute distance between a trajectory's first and last position."""
    return df.groupBy(*keys).agg(F.abs(F.max_by(position, order) - F.min_by(position, order)).alias("progress"))


def with_compat(df: DataFrame, progress_col: str, imu_col: str) -> DataFrame:
    return df.withColumn("compat", progress_compat(progress_col, imu_col))


def separated_top(df: DataFrame, key: str, score: str, position: str, k: int, separation: float) -> DataFrame:
    """Greedy top ``k`` of each key by score, each at least ``separation`` from all kept; ties by smaller position.

    A key's candidates are the cells of one track, a bounded list, folded in one expression.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-c(score)).alias("s"), c(position).cast("double").alias("p"))))
    start = F.array().cast("array<struct<s:double,p:double>>")
    kept = lambda all_: F.aggregate(
        all_, start, lambda acc, x: F.when((F.size(acc) < k) & F.forall(acc, lambda y: F.abs(y["p"] - x["p"]) >= separation), F.concat(acc, F.array(x))).otherwise(acc)
    )
    out = df.where(c(score).isNotNull()).groupBy(key).agg(ranked.alias("_a")).select(key, F.posexplode(kept(F.col("_a"))).alias("rank", "x"))
    return out.select(key, (F.col("rank") + 1).cast("long").alias("rank"), F.col("x.p").alias("position"), (-F.col("x.s")).alias("score"))


def argmax_with_runner_up(df: DataFrame, key: str, score: str, position: str, zone: float) -> DataFrame:
    """First position of the greatest score, and the greatest score outside ``zone`` of it."""
    best = df.where(c(score).isNotNull()).groupBy(key).agg(F.max(F.struct(c(score).alias("s"), (-c(position)).alias("n"))).alias("_b")).select(key, F.col("_b.s").alias("best"), (-F.col("_b.n")).alias("position"))
    other = df.join(best, key).where(F.abs(c(position) - F.col("position")) >= zone) if position != "position" else df.withColumnRenamed("position", "_p").join(best, key).where(F.abs(F.col("_p") - F.col("position")) >= zone)
    second = other.groupBy(key).agg(F.max(score).alias("second"))
    return best.join(second, key, "left")


def topk_hits(df: DataFrame, key: str, score: str, position: str, truth: str, tolerances: list[float], ks: list[int]) -> DataFrame:
    """Rank of the first candidate within each tolerance of the truth, and hits among the top k. Equal scores: larger position first."""
    w = Window.partitionBy(key).orderBy(c(score).desc_nulls_last(), c(position).desc())
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_e", F.abs(c(position) - c(truth)))
    aggs = []
    for t in tolerances:
        first = F.min(F.when(F.col("_e") <= t, F.col("_r")))
        aggs.append(first.cast("long").alias(f"rank_{t:g}"))
        aggs += [F.coalesce(first <= k, F.lit(False)).cast("int").alias(f"top{k}_{t:g}") for k in ks]
    return ranked.groupBy(key).agg(*aggs)


def progress_closest(totals: DataFrame, axes: DataFrame, key: str) -> DataFrame:
    """The axis candidate of each key where its compatibility is strictly smaller, else the total candidate. -> key, source, method, compat."""
    t = totals.select(key, F.col("method").alias("_tm"), F.col("compat").alias("_tc"))
    a = axes.select(key, F.col("method").alias("_am"), F.col("compat").alias("_ac"))
    axis = F.coalesce(F.col("_ac") < F.col("_tc"), F.lit(False))
    pick = lambda x, y: F.when(axis, F.col(x)).otherwise(F.col(y))
    return t.join(a, key, "left").select(key, F.when(axis, "axis").otherwise("total").alias("source"), pick("_am", "_tm").alias("method"), pick("_ac", "_tc").alias("compat"))
