"""Expressions over arrays of one pass or window: moments, correlation, interpolation, rolling medians.

A pass or a window is a bounded list, so these run inside a row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def mean(a: Column) -> Column:
    """Mean of the values there are; none: null."""
    return let(present(a), lambda p: total(p) / F.nullif(F.size(p).cast("double"), F.lit(0.0)))


def median(a: Column) -> Column:
    """Median of the values there are; none: null."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor(n / 2).cast("int")) + F.get(s, F.floor((n - 1) / 2).cast("int"))) / 2

    return let(F.array_sort(present(a)), middle)


def spread(a: Column, centre: Column) -> Column:
    """Population deviation of the values there are."""
    return let(present(a), lambda p: F.sqrt(total(F.transform(p, lambda x: (x - centre) * (x - centre))) / F.nullif(F.size(p).cast("double"), F.lit(0.0))))


def standardise(a: Column, least: float) -> Column:
    """(x - mean) / deviation; a deviation below ``least``: null for all."""
    return let(mean(a), lambda m: let(spread(a, m), lambda s: F.when(s >= least, F.transform(a, lambda x: (x - m) / s))))


def robust_standardise(a: Column, least: float = 1e-6, clip: float | None = 6.0) -> Column:
    """(x - median) / (1.4826 MAD), which gives way to the deviation and to 1, clipped."""

    def scaled(m: Column) -> Column:
        mad = median(F.transform(a, lambda x: F.abs(x - m))) * 1.4826
        sd = let(mean(a), lambda k: spread(a, k))
        scale = let(F.struct(mad.alias("m"), sd.alias("s")), lambda t: F.when(t["m"] >= least, t["m"]).when(t["s"] >= least, t["s"]).otherwise(1.0))
        z = lambda x, s: (x - m) / s
        cut = (lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(clip)), F.lit(-clip)))) if clip is not None else (lambda v: v)
        return let(scale, lambda s: F.transform(a, lambda x: cut(z(x, s))))

    return let(median(a), scaled)


def pairs(a: Column, b: Column) -> Column:
    """Places where both arrays have a value, as structs x, y."""
    return F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def correlation(a: Column, b: Column, least: int | Column = 3, flat: float = 1e-12) -> Column:
    """Correlation over the places where both have a value; fewer than ``least`` of them, or a flat side: null."""

    def of(p: Column) -> Column:
        n = F.size(p).cast("double")
        mx, my = total(F.transform(p, lambda t: t["x"])) / n, total(F.transform(p, lambda t: t["y"])) / n

        def moments(m: Column) -> Column:
            dev = lambda k: F.transform(p, lambda t: (t[k] - m[k]) * (t[k] - m[k]))
            both = F.transform(p, lambda t: (t["x"] - m["x"]) * (t["y"] - m["y"]))
            return let(F.struct(total(dev("x")).alias("xx"), total(dev("y")).alias("yy"), total(both).alias("xy")), lambda s: F.when((s["xx"] > flat) & (s["yy"] > flat), s["xy"] / F.sqrt(s["xx"] * s["yy"])))

        return F.when(n >= least, let(F.struct(mx.alias("x"), my.alias("y")), moments))

    return let(pairs(a, b), of)


def at(values: Column, place: Column) -> Column:
    """Value at a fractional place (0: the first) by the line between neighbours; outside: null."""
    i = F.floor(place).cast("int")
    inside = (place >= 0) & (place <= F.size(values) - 1)
    low, high = F.get(values, i), F.get(values, F.least(i + 1, F.size(values) - 1))
    return F.when(inside, F.when(place == i, low).otherwise(low + (high - low) * (place - i)))


def rolling_median(a: Column, half: Column | int, least: Column | int) -> Column:
    """Median of ``half`` places to either side and the place itself; fewer than ``least`` values: null. ``half`` may differ from row to row."""
    half, least = c(half) if isinstance(half, Column) else F.lit(half), c(least) if isinstance(least, Column) else F.lit(least)

    def window(i: Column) -> Column:
        low = F.greatest(i - half, F.lit(0))
        return present(F.slice(a, low + 1, i + half - low + 1))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: let(window(i), lambda w: F.when(F.size(w) >= least, median(w))))
