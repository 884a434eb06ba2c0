"""Window expressions over ordered passes: rolling statistics, fills, differences, integrals, runs.

Each takes a window specification ``w`` (partition by pass, order by row index). Frames are rows of that order, so a pass
is one partition; passes run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scalars import c


def by_pass(key: str | list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def odd_points(points: int) -> int:
    """An odd number of points, 3 at least."""
    points = max(3, int(points))
    return points + 1 - points % 2


def rolling_median(v: Column | str, w: WindowSpec, points: int, min_periods: int | None = None, divisor: int = 4) -> Column:
    """Centred median of ``points`` (made odd) rows; null with fewer than ``min_periods`` values (default: points // divisor, 3 at least)."""
    points = odd_points(points)
    least = max(3, points // divisor) if min_periods is None else min_periods
    frame = w.rowsBetween(-(points // 2), points // 2)
    return F.when(F.count(c(v)).over(frame) >= least, F.percentile(c(v), F.lit(0.5)).over(frame))


def moving_average(v: Column | str, w: WindowSpec, points: int) -> Column:
    """Centred mean of the values there are; one point or none: the value itself."""
    return c(v) if points <= 1 else F.avg(c(v)).over(w.rowsBetween(-(points // 2), points // 2))


def high_pass(v: Column | str, w: WindowSpec, points: int, divisor: int = 4) -> Column:
    return c(v) - rolling_median(v, w, points, divisor=divisor)


def around(key: str | list[str], order: str | list[str]) -> tuple[WindowSpec, WindowSpec]:
    """Frames of the rows up to a row, and of those from it on. The second reads the order downwards, so that both only ever grow
    and a row costs one step; a frame that ends with the pass is computed anew for each row."""
    down = [c(o).desc() for o in ([order] if isinstance(order, str) else order)]
    grown = (Window.unboundedPreceding, 0)
    return by_pass(key, order).rowsBetween(*grown), Window.partitionBy(key).orderBy(*down).rowsBetween(*grown)


def _neighbours(v: Column, x: Column, key: str | list[str], order: str | list[str]) -> tuple[Column, Column, Column, Column]:
    """Value and coordinate of the nearest value at or before, and at or after, a row."""
    back, ahead = around(key, order)
    at = F.when(v.isNotNull(), x)
    return F.last(v, True).over(back), F.last(at, True).over(back), F.last(v, True).over(ahead), F.last(at, True).over(ahead)


def between(v0: Column, x0: Column, v1: Column, x1: Column, x: Column) -> Column:
    """The line through two points, at ``x``."""
    return F.when(x1 == x0, v0).otherwise(v0 + (v1 - v0) * (x - x0) / (x1 - x0))


def linear_fill(v: Column | str, key: str | list[str], row: str, limit: int | None = None) -> Column:
    """Gaps of a pass filled by the line through their ends, by row number; outer gaps hold the nearest value.

    With ``limit`` only rows at most that many from a value are filled, except the rows that limited filling from the left
    leaves open before the first value: those stay null beyond the limit too.
    """
    v, row = c(v), c(row)
    v0, r0, v1, r1 = _neighbours(v, row, key, [row])
    filled = F.coalesce(v, between(v0, r0, v1, r1, row), v0, v1)
    if limit is None:
        return filled
    near = F.least(F.coalesce(row - r0, F.lit(1 << 30)), F.coalesce(r1 - row, F.lit(1 << 30)))
    return F.when(near <= limit, filled)


def forward_back_fill(v: Column | str, key: str | list[str], order: str, empty: Column | float | None = None) -> Column:
    v = c(v)
    back, ahead = around(key, order)
    got = F.coalesce(v, F.last(v, True).over(back), F.last(v, True).over(ahead))
    return got if empty is None else F.coalesce(got, empty if isinstance(empty, Column) else F.lit(empty))


def asof_linear(df: DataFrame, key: str, coordinate: str, values: list[str], is_query: str, clamp: bool) -> DataFrame:
    """Interpolate ``values`` of the source rows at the query rows of the same key, by one sort of their union.

    ``is_query`` marks query rows; their own values are ignored. Outside the source's range the end values hold (``clamp``) or
    null stands; a single source point gives null without ``clamp``. Returns the query rows.
    """
    x = c(coordinate).cast("double") if dict(df.dtypes)[coordinate] != "timestamp_ntz" else F.unix_micros(c(coordinate).cast("timestamp")).cast("double")
    out = df.withColumn("_x", x)
    for name in values:
        v = F.when(~c(is_query), c(name))
        v0, x0, v1, x1 = _neighbours(v, F.col("_x"), key, [coordinate, is_query])
        inside = F.when(x0.isNotNull() & x1.isNotNull(), between(v0, x0, v1, x1, F.col("_x")))
        out = out.withColumn(f"_{name}", F.coalesce(inside, v0, v1) if clamp else inside)
    out = out.where(c(is_query))
    for name in values:
        out = out.drop(name).withColumnRenamed(f"_{name}", name)
    return out.drop("_x")


def gradient(v: Column | str, x: Column | str, w: WindowSpec) -> Column:
    """Second-order central difference on uneven spacing; one-sided at the ends."""
    v, x = c(v), c(x)
    v0, v1, x0, x1 = F.lag(v).over(w), F.lead(v).over(w), F.lag(x).over(w), F.lead(x).over(w)
    a, b = x - x0, x1 - x
    inner = -(b / (a * (a + b))) * v0 + ((b - a) / (a * b)) * v + (a / (b * (a + b))) * v1
    return F.when(x0.isNull(), (v1 - v) / b).when(x1.isNull(), (v - v0) / a).otherwise(inner)


def trapezoid(v: Column | str, dt: Column, w: WindowSpec, poison: bool) -> Column:
    """Running trapezoid integral; with ``poison`` a missing sample voids all later values, else it adds nothing."""
    v = c(v)
    step = 0.5 * (v + F.lag(v).over(w)) * dt
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(step, F.lit(0.0))).over(run)
    first = F.row_number().over(w) == 1
    bad = F.max(F.when(~first & step.isNull(), 1).otherwise(0)).over(run)
    return F.when(bad == 0, total) if poison else total


def rectangle(v: Column | str, dt: Column, w: WindowSpec, low: float, high: float) -> Column:
    """Running sum of clipped values times the step to them; missing values count as zero."""
    value = F.least(F.greatest(F.coalesce(c(v), F.lit(0.0)), F.lit(low)), F.lit(high))
    return F.sum(value * F.coalesce(dt, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def run_starts(flag: Column, key: str | list[str], order: str) -> tuple[Column, Column]:
    """Gaps and islands: the running number of a row in its run of equal flags, and an island id (with the flag itself)."""
    keys = [key] if isinstance(key, str) else key
    place = F.row_number().over(Window.partitionBy(keys).orderBy(order))
    island = place - F.row_number().over(Window.partitionBy([*keys, flag]).orderBy(order))
    return place, island
