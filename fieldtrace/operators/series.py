"""Long series in blocks: fills, interpolating as-of joins and rolling medians whose work one series shares among many tasks.

A window over a series is one task's work, however long the series is. Here a long series is cut into blocks of its
coordinate. For fills and as-of joins every block hands its first and last value to the blocks beside it, over a table with one row
for each block. For rolling medians a block carries copies of the rows within half a window of it. Short series are one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..functions.windows import between, by_pass, odd_points

#: Rows of a block. Series up to so long are not cut.
BLOCK_ROWS = 65_536
#: Bins of a block's mean length by whose counts a long series is cut.
BINS = 16


def cut_blocks(df: DataFrame, keys: list[str], x: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_block``: a number that rises with the coordinate ``x`` (a number; null goes to block 0).

    A key with more than ``rows`` rows is cut where counts of its rows, in bins of equal length, reach multiples of ``rows``. Blocks
    depend on the data alone, so a repeated task gives the same. Rows of one bin stay together. The table of cuts has at
    most 16 entries for each ``rows`` rows of the input, and is broadcast.
    """
    size = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    long = size.where((F.col("_n") > rows) & (F.col("_hi") > F.col("_lo"))).withColumn("_bins", (F.ceil(F.col("_n") / rows) * BINS).cast("int"))
    place = F.least(F.floor((c(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")).cast("int"), F.col("_bins") - 1)
    binned = _join(df.select(*keys, x), F.broadcast(long), keys, "inner").where(c(x).isNotNull()).groupBy(*keys, place.alias("_bin")).agg(F.count("*").alias("_k"))
    every = long.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("_bin"))
    every = _join(every, binned, [*keys, "_bin"], "left")
    before = F.coalesce(F.sum("_k").over(by_pass(keys, "_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = every.withColumn("_at", F.floor(before / rows).cast("int")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_at"))).alias("_cuts"))
    cuts = _join(long, cuts, keys, "inner").withColumn("_cuts", F.transform("_cuts", lambda t: t["_at"]))
    out = _join(df, F.broadcast(cuts.drop("_n")), keys, "left").withColumn("_block", F.coalesce(F.get("_cuts", place), F.lit(0)))
    return out.drop("_lo", "_hi", "_bins", "_cuts")


def range_totals(points: DataFrame, t: str, value: str, spans: DataFrame, key: str, start: str, stop: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n, total): number and sum of the points inside [start, stop] of each span, from running sums read at its two ends.

    So work grows with points and spans, not with the points in each span. Sums are decimals (twelve places), hence exact in any
    order. ``key`` is unique; spans without a point, and with a null or turned-round end, have no row.
    """
    held = points.where(c(t).isNotNull() & c(value).isNotNull()).groupBy(c(t).cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(c(value).cast("decimal(28,12)")).alias("s"))
    none, nothing = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,12)")
    ends = spans.where(c(start) <= c(stop)).select(c(key).alias("key"), F.explode(F.array(F.struct(c(start).cast("double").alias("x"), F.lit(0).alias("o")), F.struct(c(stop).cast("double").alias("x"), F.lit(2).alias("o")))).alias("e"))
    both = held.select("x", F.lit(1).alias("o"), F.lit(None).alias("key"), "n", "s").unionByName(ends.select("e.x", "e.o", "key", none.alias("n"), nothing.alias("s")))
    cut = cut_blocks(both.withColumn("_one", F.lit(0)), ["_one"], "x", rows)
    block = cut.groupBy("_block").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,12)").alias("s"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = block.select("_block", F.coalesce(F.sum("n").over(ahead), none).alias("_n"), F.coalesce(F.sum("s").over(ahead), nothing).alias("_s"))
    run = Window.partitionBy("_block").orderBy("x", "o").rowsBetween(Window.unboundedPreceding, 0)
    at = cut.withColumns({"n": F.sum("n").over(run), "s": F.sum("s").over(run)}).where("o <> 1").join(F.broadcast(before), "_block")
    sign = F.when(F.col("o") == 2, 1).otherwise(-1)
    got = at.groupBy("key").agg(F.sum(sign * (F.col("n") + F.col("_n"))).alias("n"), F.sum(sign.cast("decimal(1,0)") * (F.col("s") + F.col("_s")).cast("decimal(36,12)")).alias("total"))
    return got.where("n > 0").select(F.col("key").alias(key), "n", "total")


def _join(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join whose null keys are alike; the keys of ``df`` stay."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(other.withColumnsRenamed(names), same, how).drop(*names.values())


def neighbours(df: DataFrame, keys: list[str], x: str, values: dict[str, Column], ties: list[str] | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_v0, _x0`` and ``_v1, _x1`` of each named value (``_name_v0`` and so on): the nearest value at or before and at or
    after each row in the order of ``x`` and ``ties``, with its coordinate."""
    ties = ties or []
    blocks = cut_blocks(df.withColumns({f"_{n}": v for n, v in values.items()}), keys, x, rows)
    at = [*keys, "_block"]
    held = {n: F.when(F.col(f"_{n}").isNotNull(), F.struct(x, *ties, F.col(f"_{n}").alias("_v"))) for n in values}
    ends = blocks.groupBy(*at).agg(*[f(v).alias(f"_{n}_{s}") for n, v in held.items() for f, s in ((F.min, "first"), (F.max, "last"))])
    up, down = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.col("_block").desc())
    beyond = (Window.unboundedPreceding, -1)
    carried = ends.select(*at, *[F.last(f"_{n}_last", True).over(up.rowsBetween(*beyond)).alias(f"_{n}_before") for n in values], *[F.last(f"_{n}_first", True).over(down.rowsBetween(*beyond)).alias(f"_{n}_after") for n in values])
    out = _join(blocks, carried, at, "inner")
    back = by_pass(at, [x, *ties]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*at).orderBy(*[F.col(o).desc() for o in (x, *ties)]).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_{n}_{s}": F.coalesce(F.last(held[n], True).over(w), F.col(f"_{n}_{beside}")) for n in values for s, w, beside in (("0", back, "before"), ("1", ahead, "after"))})
    parts = {f"_{n}_{p}{s}": F.col(f"_{n}_{s}")[f] for n in values for s in "01" for p, f in (("v", "_v"), ("x", x))}
    return out.withColumns(parts).drop("_block", *[f"_{n}{s}" for n in values for s in ("", "_0", "_1", "_before", "_after")])


def _drop_parts(df: DataFrame, values: list[str]) -> DataFrame:
    return df.drop(*[f"_{n}_{p}{s}" for n in values for p in "vx" for s in "01"])


def fill(df: DataFrame, keys: list[str], x: str, fills: dict[str, tuple[str, str, float | None]], ties: list[str] | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with a filled column for each new name: (column, 'linear' or 'hold', limit).

    'linear' fills gaps along ``x`` by the line through their ends, and outer gaps with the nearest value; 'hold' fills a gap with the value
    before it, or the one after where there is none. With a limit only rows at most so far (in ``x``) from a value are filled.
    Keys may be null; rows of one ``x`` are ordered by ``ties``. All fills share one pass over the blocks.
    """
    columns = sorted({v for v, _, _ in fills.values()})
    out = neighbours(df, keys, x, {v: c(v) for v in columns}, ties, rows)
    made = {}
    for name, (v, how, limit) in fills.items():
        v0, x0, v1, x1 = (F.col(f"_{v}_{p}") for p in ("v0", "x0", "v1", "x1"))
        filled = F.coalesce(c(v), between(v0, x0, v1, x1, c(x)) if how == "linear" else v0, v0, v1)
        if limit is not None:
            filled = F.when(F.coalesce(F.least(c(x) - x0, x1 - c(x)), c(x) - x0, x1 - c(x)) <= limit, filled)
        made[name] = filled
    return _drop_parts(out.withColumns(made), columns)


def asof_linear(df: DataFrame, keys: list[str], x: str, values: list[str], is_query: str, clamp: bool, rows: int = BLOCK_ROWS) -> DataFrame:
    """``functions.windows.asof_linear`` for series of any length: ``values`` of the source rows, interpolated at the query rows.

    Sources at the coordinate of a query come before it; of several sources at one coordinate the greatest value counts. Outside the source's range
    the end values hold (``clamp``) or null stands.
    """
    out = neighbours(df, keys, x, {n: F.when(~c(is_query), c(n)) for n in values}, [is_query], rows).where(c(is_query))
    for n in values:
        v0, x0, v1, x1 = (F.col(f"_{n}_{p}") for p in ("v0", "x0", "v1", "x1"))
        inside = F.when(x0.isNotNull() & x1.isNotNull(), between(v0, x0, v1, x1, c(x)))
        out = out.withColumn(n, F.coalesce(inside, v0, v1) if clamp else inside)
    return _drop_parts(out, values)


# ---- rolling medians
def rolling_median(df: DataFrame, keys: list[str], row: str, values: dict[str, tuple[str, int | Column, int | Column]], rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with a centred rolling median for each new name: (column, points, least number of values).

    ``row`` numbers the rows of a key without gaps. Points may be a column that is the same for all rows of a key; even ones get
    one more, and there are 3 at least. A median needs its least number of values, else it is null. Windows end where the series ends.

    Rows are dealt to blocks of ``rows`` (or of a window, where that is longer), with copies for the blocks beside; a task keeps each
    window in order while it slides, so a row costs the logarithm of the window.
    """
    wide = {n: (v, p if isinstance(p, Column) else F.lit(odd_points(p)), F.lit(k) if isinstance(k, int) else k) for n, (v, p, k) in values.items()}
    half = F.greatest(*[F.floor(p / 2) for _, p, _ in wide.values()], F.lit(1)).cast("long")
    block = F.greatest(half, F.lit(rows))
    at = F.floor(c(row) / block)
    own = F.filter(F.array(at, F.floor((c(row) - half) / block), F.floor((c(row) + half) / block)), lambda b: b >= 0)
    extra = {f"_{n}_{s}": e for n, (v, p, k) in wide.items() for s, e in (("v", c(v).cast("double")), ("h", F.floor(p / 2).cast("int")), ("k", k.cast("int")))}
    dealt = df.withColumns({**extra, "_own": at}).withColumn("_block", F.explode(F.array_distinct(own)))
    kept, names = list(df.columns), list(values)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in values)

    def medians(table: pa.Table, groups: np.ndarray) -> pa.Table:
        made = {n: pa.array(sliding_medians(_floats(table[f"_{n}_v"]), groups, table[f"_{n}_h"].to_numpy(), table[f"_{n}_k"].to_numpy()), pa.float64(), from_pandas=True) for n in names}
        out = pa.table([*(table[x] for x in kept), *made.values()], names=[*kept, *made])
        return out.filter(pa.array(table["_own"].to_numpy() == table["_block"].to_numpy()))

    return in_groups(dealt, [*keys, "_block"], row, medians, schema)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.float64)


def sliding_medians(v: np.ndarray, groups: np.ndarray, half: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Centred medians of runs of rows: ``groups`` has where each run begins, and the end. NaN is no value.

    Runs with windows of one size are laid out with half a window of gaps between them, so that no window sees two runs. The window is an
    ordered list that one value enters and one leaves at each step.
    """
    out = np.full(len(v), np.nan)
    if not len(v):
        return out
    sizes = np.diff(groups)
    kinds = np.stack([half[groups[:-1]], least[groups[:-1]]], axis=1)
    for h, k in np.unique(kinds, axis=0):
        runs = np.flatnonzero((kinds == (h, k)).all(axis=1))
        n, begin = sizes[runs], groups[:-1][runs]
        laid = np.concatenate([[0], np.cumsum(n + h)])[:-1]
        inside = np.repeat(np.arange(len(runs)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        padded = np.full(int((n + h).sum()), np.nan)
        padded[laid[inside] + step] = v[begin[inside] + step]
        got = pd.Series(padded).rolling(2 * int(h) + 1, center=True, min_periods=max(1, int(k))).median().to_numpy()
        out[begin[inside] + step] = got[laid[inside] + step]
    return out


def in_groups(df: DataFrame, keys: list[str], order: str, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``run`` on tables of whole groups of ``keys``, in order, with the places where groups begin (and the end); many groups at a time.

    A task reads its sorted rows as they come and keeps back only the last, unfinished group of what it has read.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            first = _group_starts(table, keys)
            rest = table.slice(first[-1])
            if first[-1]:
                yield from run(table.slice(0, first[-1]).combine_chunks(), first).to_batches()
        if rest is not None:
            yield from run(rest.combine_chunks(), np.array([0, rest.num_rows])).to_batches()

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order).mapInArrow(tables, schema)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)
