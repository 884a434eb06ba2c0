"""Feature bundles of passes: standardised vectors, high-passes with a step of their own, track features, references made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, stats, windows
from ..functions.scalars import c
from ..functions.windows import by_pass


def enough(v: Column | str, share: float, w) -> Column:
    """Whether at least ``share`` of a group's rows have a value."""
    return F.count(c(v)).over(w) >= share * F.count("*").over(w)


def vector_standardise(df: DataFrame, keys: list[str], row: str, v: str, out: str = "z", share: float = 0.75, least: float = 1e-6) -> DataFrame:
    """z-score of each group's filled values; a group with less than ``share`` of its values, or a flat one, is null throughout."""
    w = Window.partitionBy(keys)
    rows = df.withColumn("_f", F.when(enough(v, share, w), windows.linear_fill(v, keys, row)))
    return rows.withColumn(out, stats.z_score("_f", w, least)).drop("_f")


def window_robust_z(df: DataFrame, keys: list[str], row: str, v: str, out: str = "z", share: float = 0.8) -> DataFrame:
    """Robust z of each group's filled values; with less than ``share`` of its values a group is null throughout."""
    w = Window.partitionBy(keys)
    rows = df.withColumn("_f", F.when(enough(v, share, w), windows.linear_fill(v, keys, row)))
    return stats.robust_z(rows, keys, "_f", out).drop("_f")


def adaptive_high_pass(df: DataFrame, keys: list[str], x: str, v: str, metres: float, out: str = "hp", divisor: int = 4) -> DataFrame:
    """``v`` less its rolling median over ``metres``, whose points come from each pass's own median step.

    Frames of a window are the same for all passes, so a pass is one array here: -> keys, x, v, out.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c(x).alias("x"), c(v).alias("v")))).alias("_a"))
    rows = rows.withColumn("_x", F.transform("_a", lambda t: t["x"])).withColumn("_v", F.transform("_a", lambda t: t["v"]))
    steps = F.transform(F.sequence(F.lit(1), F.size("_x") - 1), lambda i: F.get("_x", i) - F.get("_x", i - 1))
    step = F.when(F.size("_x") > 1, arrays.median(F.filter(steps, lambda d: d > 0)))
    points = F.greatest(F.lit(3), F.floor(F.lit(metres) / step).cast("int"))
    points = F.coalesce(points + 1 - points % 2, F.lit(3))
    rows = rows.withColumn("_p", points)
    smooth = arrays.rolling_median(F.col("_v"), F.floor(F.col("_p") / 2).cast("int"), F.greatest(F.lit(3), F.floor(F.col("_p") / divisor).cast("int")))
    rows = rows.withColumn("_s", smooth)
    return rows.select(*keys, F.posexplode(F.arrays_zip("_x", "_v", "_s")).alias("_i", "t")).select(*keys, F.col("t._x").alias(x), F.col("t._v").alias(v), (F.col("t._v") - F.col("t._s")).alias(out))


def track_features(df: DataFrame, key: str, order: str, direction: str, x: str, y: str, z: str, high_pass: tuple[int, int] = (71, 91)) -> DataFrame:
    """Per-pass anomalies turned into the track's frame, and their high-passes: adds tx, ty, tz, total, hp (of total) and hp_y (of ty)."""
    w, o = Window.partitionBy(key), by_pass(key, order)
    d = F.when(c(direction) > 0, 1).otherwise(-1)
    a = {n: c(n) - stats.median(n).over(w) for n in (x, y, z)}
    out = df.withColumns({"tx": -a[x] * d, "ty": a[y] * d, "tz": a[z]})
    out = out.withColumn("total", F.sqrt(c(x) ** 2 + c(y) ** 2 + c(z) ** 2) - F.percentile(F.sqrt(c(x) ** 2 + c(y) ** 2 + c(z) ** 2), F.lit(0.5)).over(w))
    return out.withColumn("hp", windows.high_pass("total", o, high_pass[0])).withColumn("hp_y", windows.high_pass("ty", o, high_pass[1]))


def legacy_features(df: DataFrame, key: str, order: str, stored: str, points: int = 71) -> DataFrame:
    """Features of passes that hold a stored anomaly: the anomaly itself and its high-pass."""
    return df.withColumn("anomaly", c(stored)).withColumn("hp", windows.high_pass(stored, by_pass(key, order), points))


def query_features(df: DataFrame, keys: list[str], x: str, v: str, other: str, metres: float, share: float = 0.75) -> DataFrame:
    """Adaptive high-pass and gradient of ``v``, and the high-pass of ``other`` where enough of it is there: -> keys, x, v, hp, grad, hp_other."""
    main = adaptive_high_pass(df, keys, x, v, metres)
    main = main.withColumn("grad", windows.gradient(v, x, by_pass(keys, x)))
    ok = df.groupBy(*keys).agg((F.count(other) >= share * F.count("*")).alias("_ok"))
    second = adaptive_high_pass(df, keys, x, other, metres, "hp_other").join(ok.where("_ok").select(*keys), keys, "left_semi").select(*keys, x, "hp_other")
    return main.join(second, [*keys, x], "left")


def map_features(grid: DataFrame, key: str = "pass", cell: str = "cell", v: str = "v", step: float = 0.5, points: int = 9) -> DataFrame:
    """Long features of a gridded map or pass: robust z of the total, of its high-pass and of its gradient. -> key, cell, f, v."""
    o, w = by_pass(key, cell), Window.partitionBy(key)
    rows = grid.select(key, cell, (c(v) - stats.median(v).over(w)).alias("total"), windows.high_pass(v, o, points).alias("hp"), windows.gradient(v, c(cell) * step, o).alias("grad"))
    long = rows.unpivot([key, cell], ["total", "hp", "grad"], "f", "_v")
    return stats.robust_z(long, [key, "f"], "_v", "v").select(key, cell, "f", "v")


def feature_reference(features: DataFrame, bad: DataFrame | None = None, key: str = "pass") -> DataFrame:
    """Mean of the passes' features in each cell; with ``bad`` without the passes it lists. -> cell, f, v."""
    rows = features if bad is None else features.join(bad.select(key), key, "left_anti")
    return rows.groupBy("cell", "f").agg(F.avg("v").alias("v"))


def hmm_reference(reference: DataFrame, points: int = 5) -> DataFrame:
    """Reference features filled along the cells, smoothed by a median and robust-standardised. -> cell, f, v."""
    w = by_pass("f", "cell")
    rows = reference.withColumn("_f", windows.linear_fill("v", "f", "cell")).drop("v")
    rows = rows.withColumn("_s", windows.rolling_median("_f", w, points, min_periods=1))
    return stats.robust_z(rows, ["f"], "_s", "v").select("cell", "f", "v")


def reference_family(grid: DataFrame, sets: DataFrame, key: str = "pass", cell: str = "cell", v: str = "v") -> DataFrame:
    """Median map of each named set of passes (name, key). -> name, cell, v."""
    return grid.join(sets, key).groupBy("name", cell).agg(stats.median(v).alias(v))


def projected(east: Column | str, north: Column | str, ue: float, un: float) -> Column:
    """Velocity along the track's unit vector."""
    return c(east) * ue + c(north) * un
