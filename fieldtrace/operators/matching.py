"""Matching of query windows and passes against a reference map.

The reference is one track's cells, a table whose size is counted before it is gathered and handed to all tasks. Scores are computed where
the query's pass is, all places of the map at once, so nothing is shuffled for them, whatever the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.scalars import c
from . import sliding

#: Values of a reference (windows times their length, or cells) that one row may hold.
MAX_VALUES = 4_000_000


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row on every row."""
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(row.withColumn("_one", F.lit(0))), "_one").drop("_one")


def checked(df: DataFrame, values: Column, most: int, what: str) -> DataFrame:
    """``df``, or an error where its ``values`` sum to more than ``most``. They are summed first, so nothing is gathered before the check."""
    size = df.agg(F.sum(values.cast("long")).alias("_size"))
    refused = F.raise_error(F.lit(f"the {what} is too large; split the track")).cast("boolean")
    return beside(df, size).where(F.when(F.coalesce("_size", F.lit(0)) <= most, True).otherwise(refused)).drop("_size")


def one_row(df: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    """A bounded table as one array, in the order of its columns; refused beyond MAX_VALUES values (an array counts its items)."""
    picked = df.select(*columns)
    values = sum((F.coalesce(F.size(x), F.lit(0)) if t.startswith("array") else F.lit(1) for x, t in picked.dtypes), F.lit(0))
    return checked(picked, values, MAX_VALUES, "reference").agg(F.array_sort(F.collect_list(F.struct(*picked.columns))).alias(name))


def reference_arrays(features: DataFrame) -> dict[str, np.ndarray]:
    """Every feature's values by cell from 0 on (NaN: none) of one track's map, counted before it is gathered."""
    last = features.agg(F.max("cell").alias("n"), F.countDistinct("f").alias("k")).first()
    if last["n"] is None:
        return {}
    if (last["n"] + 1) * last["k"] > MAX_VALUES:
        raise ValueError("the reference is too large; split the track")
    rows = features.where("cell >= 0").select("f", F.col("cell").cast("long").alias("cell"), F.col("v").cast("double").alias("v")).toArrow()
    out = {f: np.full(last["n"] + 1, np.nan) for f in set(rows["f"].to_pylist())}
    name, cell, v = np.array(rows["f"].to_pylist(), dtype=object), rows["cell"].to_numpy(), rows["v"].to_numpy()
    for f, values in out.items():
        own = name == f
        values[cell[own]] = v[own]
    return out


def window_scores(features: DataFrame, reference: DataFrame, keys: list[str], n: int, stride: int, variants: dict[str, tuple[list[str], str]], share: float = 1.0) -> DataFrame:
    """Windows of ``n`` cells of each pass (keys, f, cell, v) at every ``stride``-th start against all windows of a map (f, cell, v).

    -> keys, start and for each variant (features, mode) a column of (s, score) of every start of the map: the mean over the features
    of the correlation ('ncc') or of the negative mean squared difference ('msd') of the standardised windows. A window counts if
    it begins with a value, has one in ``share`` of its cells, and is not flat, in each of its pass's features. The map is a counted, bounded
    table that every task holds; a task takes passes as they come and scores all starts of a window at once, by sliding products.
    """
    ref = reference_arrays(reference)
    context = features.sparkSession.sparkContext
    shared = context.broadcast((ref, {f: sliding.Windows(v, n, share) for f, v in ref.items()}))
    chosen = {name: (list(fs), mode) for name, (fs, mode) in variants.items()}
    passes = features.select(*keys, F.struct("f", F.col("cell").cast("long").alias("cell"), F.col("v").cast("double").alias("v")).alias("_t")).groupBy(*keys).agg(F.collect_list("_t").alias("_t"))
    kinds = dict(features.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "start long", *(f"`{name}` array<struct<s:long,score:double>>" for name in chosen)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, windows = shared.value
        good = np.logical_and.reduce([w.good for w in windows.values()]) if windows else np.empty(0, dtype=bool)
        places = np.flatnonzero(good)
        for batch in batches:
            lists = batch.column(len(keys))
            ends, flat = np.asarray(lists.offsets), lists.values
            f, cell, v = np.array(flat.field(0).to_pylist(), dtype=object), flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)
            rows, starts, made = [], [], {name: [] for name in chosen}
            for i in range(batch.num_rows):
                own = slice(ends[i], ends[i + 1])
                size, names = int(cell[own].max()) + 1, sorted(set(f[own]))
                arrays_of = {}
                for x in names:
                    at = f[own] == x
                    arrays_of[x] = np.full(size, np.nan)
                    arrays_of[x][cell[own][at]] = v[own][at]
                query = {x: sliding.Windows(a, n, share) for x, a in arrays_of.items()}
                ok = np.flatnonzero(np.logical_and.reduce([w.good for w in query.values()]))
                ok = ok[ok % stride == 0]
                if not len(ok) or not len(places):
                    continue
                rows += [i] * len(ok)
                starts.append(ok)
                cut = {x: query[x].at(ok) for x in {y for fs, _ in chosen.values() for y in fs}}
                for name, (fs, mode) in chosen.items():
                    made[name].append(sum(windows[x].scores(cut[x], mode)[:, places] for x in fs) / len(fs))
            if rows:
                at = np.concatenate(starts)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in range(len(keys))), pa.array(at), *(_score_lists(places, np.concatenate(made[name])) for name in chosen)], names=[*keys, "start", *chosen])

    return passes.mapInArrow(run, schema)


def _score_lists(places: np.ndarray, scores: np.ndarray) -> pa.Array:
    """Rows of scores as lists of (s, score)."""
    pairs = pa.StructArray.from_arrays([pa.array(np.tile(places, len(scores))), pa.array(scores.ravel())], names=["s", "score"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * len(places)), pairs)


def near_only(scores: Column | str, near: Column, radius: float | None) -> Column:
    """The scores of places within ``radius`` of ``near``."""
    return c(scores) if radius is None else F.filter(scores, lambda t: F.abs(t["s"] - near) <= radius)


def top_entry(scores: Column | str) -> Column:
    """(score, m) of the greatest score, m being the first such place with its sign turned. Scores the same up to nine decimals are equal."""
    ranked = lambda t: F.struct(F.floor(t["score"].cast("double") * 1e9 + 0.5).alias("k"), (-t["s"]).alias("m"), t["score"].alias("score"))
    return F.array_max(F.transform(F.filter(scores, lambda t: t["score"].isNotNull() & ~F.isnan(t["score"])), ranked))


def best_of(df: DataFrame, keys: list[str], zone: float, scores: Column | str = "scores") -> DataFrame:
    """First place of the greatest score, that score, and the greatest ``zone`` or further away."""
    rows = df.select(*keys, c(scores).alias("_k")).withColumn("_b", top_entry("_k"))
    second = F.array_max(F.transform(F.filter("_k", lambda t: F.abs(t["s"] + F.col("_b.m")) >= zone), lambda t: t["score"]))
    return rows.where("_b is not null").select(*keys, (-F.col("_b.m")).alias("pred"), F.col("_b.score").alias("best"), second.alias("second"))


def pass_arrays(df: DataFrame, keys: list[str], cell: str = "cell", v: str = "v") -> DataFrame:
    """Cells and values of each pass in order: keys, c, q."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c(cell).alias("c"), c(v).alias("v")))).alias("_a"))
    return rows.select(*keys, F.transform("_a", lambda t: t["c"]).alias("c"), F.transform("_a", lambda t: t["v"]).alias("q"))


def search_starts(query: DataFrame, reference: DataFrame | None, keys: list[str], scales: list[float], start_step: int, direction: int = 1, share: float = 0.85, lags: tuple[int, int] | None = None, least: int = 3) -> DataFrame:
    """keys and ``tries``: (scale, s, score) of laying the query (rel, q) out from every start at every scale of its relative distance.

    The reference is (cell, v), cells from 0 without gaps, one counted map that every task holds; without one each row brings its own
    as ``ref`` (an array). Between cells it is linear. A try needs ``share`` of the query inside it, and ``least`` values. Starts are all cells
    in steps, or the whole numbers from ``lags[0]`` to ``lags[1]``. All starts of a scale are scored at once by sliding sums.
    """
    own = reference is None
    held = None if own else reference_arrays(reference.select(F.lit("v").alias("f"), "cell", "v")).get("v", np.empty(0))
    shared = query.sparkSession.sparkContext.broadcast(held)
    kinds = dict(query.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "tries array<struct<scale:double,s:int,score:double>>"])
    rows = query.select(*keys, F.col("rel").cast("array<double>").alias("rel"), F.col("q").cast("array<double>").alias("q"), *([F.col("ref").cast("array<double>").alias("ref")] if own else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        for batch in batches:
            tries = []
            rel, q = (batch.column(k + j).to_pylist() for j in (0, 1))
            refs = batch.column(k + 2).to_pylist() if own else [None] * batch.num_rows
            for d, y, mine in zip(rel, q, refs, strict=True):
                ref = np.array(mine, dtype=np.float64) if own else shared.value
                starts, found = np.arange(0, len(ref), start_step) if lags is None else np.arange(lags[0], lags[1] + 1, start_step), []
                for scale in scales:
                    if len(starts):
                        score = sliding.laid_correlations(ref, np.array(y, dtype=np.float64), direction * scale * np.array(d, dtype=np.float64), starts, max(least, math.ceil(share * len(d))))
                        found += [(float(scale), int(s), float(x)) for s, x in zip(starts, score, strict=True) if not np.isnan(x)]
                tries.append([{"scale": a, "s": b, "score": x} for a, b, x in found])
            kind = pa.list_(pa.struct([("scale", pa.float64()), ("s", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(k)), pa.array(tries, kind)], names=[*keys, "tries"])

    return rows.mapInArrow(run, schema)


def best_try(df: DataFrame, keys: list[str], zone: float = 20.0) -> DataFrame:
    """Best start and scale (first of equal ones), score, the runner-up ``zone`` or further away, and the margin between them."""
    rows = df.select(*keys, "tries", F.array_max(F.transform("tries", lambda t: F.struct(t["score"].alias("score"), (-t["s"]).alias("m"), (-t["scale"]).alias("k")))).alias("_b"))
    second = F.array_max(F.transform(F.filter("tries", lambda t: F.abs(t["s"] + F.col("_b.m")) >= zone), lambda t: t["score"]))
    out = rows.where("_b is not null").select(*keys, (-F.col("_b.m")).alias("start"), (-F.col("_b.k")).alias("scale"), F.col("_b.score").alias("score"), second.alias("second"))
    return out.withColumn("margin", F.col("score") - F.coalesce("second", F.lit(0.0)))


def distinctive(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """The window of each pass that stands out most: margin + 0.25 score + 0.0005 length; the first of equal ones."""
    rows = df.withColumn("merit", F.col("margin") + 0.25 * F.col("score") + 0.0005 * c(length))
    w = Window.partitionBy(keys).orderBy(F.col("merit").desc(), length, "first")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_own(grid: DataFrame, key: str = "pass", cell: str = "cell", v: str = "v") -> DataFrame:
    """For each pass the mean of all others as one array: key, ref. From the cells' totals, which are one row, less the pass's own."""
    total = grid.groupBy(cell).agg(F.sum(v).alias("s"), F.count(v).alias("n"))
    all_ = one_row(total, "_t", cell, "s", "n")
    own = grid.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(cell, v))).alias("_own"))
    ref = F.transform("_t", lambda t: let_less(t, F.try_element_at("_own", t[cell])))
    return beside(own, all_).select(key, ref.alias("ref"))


def let_less(t: Column, own: Column) -> Column:
    """Mean of a cell's total without one value; null where nothing is left."""
    n = t["n"] - F.when(own.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, (t["s"] - F.coalesce(own, F.lit(0.0))) / n)
