"""Grid maps over passes, in the long layout (pass, cell, value): fused statistics, references, gates and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, windows
from . import matching


#: Cells that one track's map may have where it is smoothed along them, which takes the whole map in order.
MAX_CELLS = 4_000_000


def bounded(cells: DataFrame) -> DataFrame:
    """The cells of one map; an error beyond MAX_CELLS, which are counted before they meet in one task."""
    return matching.checked(cells, F.lit(1), MAX_CELLS, "map")


def fused_map(grid: DataFrame, cell: str = "cell", value: str = "v", smooth_points: int = 11) -> DataFrame:
    """Per cell: count, median, mean, sample deviation and MAD across passes, and the median smoothed along the cells."""
    rows = stats.with_mad(grid.where(F.col(value).isNotNull()), [cell], value)
    out = rows.groupBy(cell).agg(
        F.count("*").alias("n"), F.first("med").alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.first("mad").alias("mad")
    )
    return bounded(out).withColumn("smooth", windows.rolling_median("median", Window.partitionBy(F.lit(0)).orderBy(cell), smooth_points))


def bin_counts(df: DataFrame, keys: list[str], coordinate: str, per_metre: int, low: int, high: int) -> DataFrame:
    """Samples per half-even-rounded cell, zero where a cell of the grid has none."""
    own = df.groupBy(*keys, F.bround(F.col(coordinate) * per_metre, 0).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    cells = df.select(*keys).distinct().withColumn("cell", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    return cells.join(own, [*keys, "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def stack(grid: DataFrame, how: str, cell: str = "cell", value: str = "v") -> DataFrame:
    """Mean or median of passes per cell."""
    agg = F.avg(value) if how == "mean" else stats.median(value)
    return grid.groupBy(cell).agg(agg.alias(value))


def reference(grid: DataFrame, weight: str | None = None, cell: str = "cell", value: str = "v", smooth_points: int = 11) -> DataFrame:
    """Median (or weighted median) of passes per cell, gaps filled along the cells, smoothed."""
    made = stack(grid, "median", cell, value) if weight is None else stats.weighted_median(grid, [cell], value, weight, value)
    cells = grid.select(cell).distinct().join(made, cell, "left")
    w = Window.partitionBy(F.lit(0)).orderBy(cell)
    filled = bounded(cells).withColumn(value, windows.linear_fill(value, F.lit(0), cell))
    return filled.withColumn(value, windows.rolling_median(value, w, smooth_points, min_periods=1))


def spread(grid: DataFrame, cell: str = "cell", value: str = "z") -> DataFrame:
    """Quartile and decile summary of the population deviation across passes."""
    by_cell = grid.groupBy(cell).agg(F.stddev_pop(value).alias("sd"))
    p = F.percentile("sd", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    return by_cell.agg(p.alias("p")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p75"), F.col("p")[2].alias("p90"))


def soft_weight(error: Column, score: Column) -> Column:
    """Weight of a pass from its hold-out error and score."""
    ramp = F.least(F.greatest((score - 0.35) / 0.35, F.lit(0.0)), F.lit(1.0))
    return 0.15 + 0.85 * F.exp(-((error / 50) ** 2)) * ramp


def hard_gate(error: Column, score: Column, max_error: float = 2.0, min_score: float = 0.60) -> Column:
    return (error <= max_error) & (score >= min_score)


def full_and_common_grid(grid: DataFrame, key: str, cell: str, step: float, most: int) -> DataFrame:
    """Points of ``step`` from 0 to the track's end (at most ``most`` metres) -> half, x, common: inside the median pass's range."""
    spans = grid.groupBy(key).agg(F.min(cell).alias("lo"), F.max(cell).alias("hi"))
    ends = spans.agg(F.max("hi").alias("top"), stats.median("lo").alias("lo"), stats.median("hi").alias("hi"))
    points = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), (F.least(F.lit(most), F.col("top")) / step).cast("long"))).alias("half"))
    return points.select("half", (F.col("half") * step).alias("x"), (F.col("half") * step).between(F.col("lo"), F.col("hi")).alias("common"))


def wide_map(grid: DataFrame, passes: list[int], key: str = "pass", cell: str = "cell", value: str = "v") -> DataFrame:
    """Per cell the statistics of all passes and a column for each of ``passes``, for export."""
    picked = [F.max(F.when(F.col(key) == p, F.col(value))).alias(f"{key}_{p}") for p in passes]
    return grid.groupBy(cell).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), stats.median(value).alias("median"), *picked)


def long_map(wide: DataFrame, cell: str, prefix: str) -> DataFrame:
    """Columns of a wide map that begin with ``prefix`` as rows: cell, channel, v."""
    return wide.unpivot([cell], [n for n in wide.columns if n.startswith(prefix)], "channel", "v")


def quality_references(grid: DataFrame, quality: DataFrame, error: str, score: str, key: str = "pass", cell: str = "cell", value: str = "v") -> tuple[DataFrame, DataFrame]:
    """(cell, hard): median of the passes that the gate accepts; (cell, soft): median weighted by quality. ``quality`` has one row for each pass."""
    rows = grid.join(quality.select(key, hard_gate(F.col(error), F.col(score)).alias("_ok"), soft_weight(F.col(error), F.col(score)).alias("_w")), key)
    return rows.where("_ok").groupBy(cell).agg(stats.median(value).alias("hard")), stats.weighted_median(rows, [cell], value, "_w", "soft")
