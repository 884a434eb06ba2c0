"""Pairs of windows of different passes that lie near each other and look alike: a theta join on ranges.

Windows are standardised, so the correlation of two is a product.

- exact: windows are dealt to blocks, and each two blocks meet in one task (``joins.block_pairs``). There the windows of a start meet those of the
  starts within ``radius``, as matrices of whose product only the entries over the threshold leave the task. Nothing is copied for each
  meeting, so disk grows with the windows.
- bands: two windows within ``radius`` cells lie in one bucket of that width or in neighbours, so every window goes to its own bucket and the
  next one, and a pair is met in the bucket of its later window, but only where random hyperplanes put both on the same sides in at least
  one of several bands. Much less is compared, and a few pairs near the threshold are missed; ``expected_recall`` says how many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins

#: Windows of a block in the exact mode, entries of a tile of the product of two, and pairs that are verified and handed on together.
GROUP, TILE, HANDED = 65536, 1 << 18, 1 << 16
#: Bands of hyperplanes and planes of a band; their seed.
BANDS, PLANES, SEED = 16, 6, 7
_OUT = "a long, a_start long, b long, b_start long, similarity double"


def expected_recall(similarity: float, bands: int = BANDS, planes: int = PLANES) -> float:
    """Share of pairs of one similarity that share a band: a plane parts two vectors with probability angle / pi."""
    same = 1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi
    return 1 - (1 - same**planes) ** bands


def alike_windows(windows: DataFrame, key: str, radius: int, least: float, mode: str = "exact", group: int = GROUP, bands: int = BANDS, planes: int = PLANES) -> DataFrame:
    """``a, a_start, b, b_start, similarity``: windows (key, start, w) of passes a < b with starts at most ``radius`` apart and a
    correlation of at least ``least``.

    ``w`` are standardised windows of one length n (mean 0, sum of squares n). Keys and starts are not null. Two windows of one pass
    meet (the earlier is a) only where a boolean column ``many`` is there and true for one of them.
    """
    many = F.col("many") if "many" in windows.columns else F.lit(False)
    rows = windows.select(F.col(key).cast("long").alias("k"), F.col("start").cast("long").alias("s"), "w", many.alias("many"))
    if mode == "bands":
        n = windows.select(F.size("w")).first()
        if n is None:
            return windows.sparkSession.createDataFrame([], _OUT)
        placed = rows.withColumn("own", F.floor(F.col("s") / (radius + 1)))
        # a window meets those of its own bucket there, and later ones of the next bucket in that one
        placed = placed.withColumn("bucket", F.explode(F.array("own", F.col("own") + 1)))

        def meet(table: pa.Table) -> pa.Table:
            own, bucket = table["own"].to_numpy(), table["bucket"].to_numpy()
            side = _sides(*(table[c].combine_chunks() for c in ("k", "s", "w", "many")))
            # the later window is at home here
            parts = [pa.RecordBatch.from_pydict(_columns(side, side, p[at], q[at], least)) for p, q in _met(side, side, True, radius, least) if len(at := np.flatnonzero(np.maximum(own[side[4][p]], own[side[4][q]]) == bucket[0]))]
            return pa.Table.from_batches(parts, _SCHEMA)

        met = _banded(placed, n[0], bands, planes).groupBy("bucket", "band", "side").applyInArrow(meet, _OUT)
        return met.dropDuplicates(["a", "a_start", "b", "b_start"])
    count, one = rows.count(), rows.select(F.size("w")).first()  # all windows have one length; counting them all does not make them

    def meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alike, left, right in joins.blocks_of(batches):
            left, right = (_sides(*(x.field(c) for c in ("k", "s", "w", "many"))) for x in (left, right))
            for p, q in _met(left, right, alike, radius, least):
                yield pa.RecordBatch.from_pydict(_columns(left, right, p, q, least), _SCHEMA)

    blocks = joins.block_number(windows.sparkSession, count, count * one[0] if one else 0, group)
    return joins.block_pairs(rows, F.struct("k", "s"), blocks).mapInArrow(meet_all, _OUT)


_SCHEMA = pa.schema([("a", pa.int64()), ("a_start", pa.int64()), ("b", pa.int64()), ("b_start", pa.int64()), ("similarity", pa.float64())])


def _sides(k: pa.Array, s: pa.Array, w: pa.Array, many: pa.Array) -> tuple[np.ndarray, ...]:
    """Passes, starts, windows as a matrix and ``many``, by start, and the order that they were in."""
    s = s.to_numpy(zero_copy_only=False)
    order = np.argsort(s, kind="stable")
    w = w.flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1)
    return k.to_numpy(zero_copy_only=False)[order], s[order], w[order], many.to_numpy(zero_copy_only=False)[order], order


def _met(left: tuple, right: tuple, alike: bool, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both sides of the pairs to be verified, some tiles' at a time. Of one block (``alike``) a pair comes in both orders, and once is kept."""
    (k, s, w, many, _), (l, t, v, lots, _) = left, right
    # products in single precision, and a threshold that is lower by what they may be off
    n = w.shape[1]
    small, turned, bound = w.astype(np.float32), v.astype(np.float32).T.copy(), n * (least - 1e-9 * abs(least) - (n + 4) * 1.2e-7)
    starts, firsts = np.unique(s, return_index=True)

    def kept(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        # of two windows of one pass the earlier is a, and they meet only where one of them is of many
        other = k[p] != l[q]
        own = ~other & (many[p] | lots[q])
        before = np.where(other, k[p] < l[q], s[p] < t[q])
        keep = np.flatnonzero((other | (own & (s[p] != t[q]))) & (before | (not alike)))
        return p[keep], q[keep]

    found, size = [], 0
    for start, first, end in zip(starts, firsts, [*firsts[1:], len(s)], strict=True):
        lo, hi = np.searchsorted(t, start - radius, "left"), np.searchsorted(t, start + radius, "right")
        for on in range(lo, hi, 1024):
            to = min(hi, on + 1024)
            step = max(1, TILE // (to - on))
            for at in range(first, end, step):
                p, q = np.divmod(_places(small[at : min(end, at + step)] @ turned[:, on:to] >= bound), to - on)
                if len(p):
                    found.append((p + at, q + on))
                    size += len(p)
                if size >= HANDED:
                    yield kept(found)
                    found, size = [], 0
    if found:
        yield kept(found)


def _places(hit: np.ndarray) -> np.ndarray:
    """The places of few true values, looked for eight at a time."""
    flat = hit.ravel()
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64) != 0)
    word, byte = np.nonzero(flat[:even].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + byte, even + np.flatnonzero(flat[even:])])


def _columns(left: tuple, right: tuple, p: np.ndarray, q: np.ndarray, least: float) -> dict[str, np.ndarray]:
    """Columns of the pairs whose correlation is large enough, the smaller pass (of one pass, the earlier start) first."""
    (k, s, w, _, _), (l, t, v, _, _) = left, right
    score = np.einsum("ij,ij->i", w[p], v[q]) / w.shape[1]
    at = np.flatnonzero(score >= least)
    p, q, score = p[at], q[at], score[at]
    swap = (k[p] > l[q]) | ((k[p] == l[q]) & (s[p] > t[q]))
    pick = lambda x, y: (np.where(swap, y[q], x[p]), np.where(swap, x[p], y[q]))
    (a, b), (a_start, b_start) = pick(k, l), pick(s, t)
    return {"a": a, "a_start": a_start, "b": b, "b_start": b_start, "similarity": score}


def alike_classes(windows: DataFrame, key: str, radius: int, least: float, **kw) -> DataFrame:
    """``kind, a, a_start, b, b_start, similarity``: ``alike_windows`` without its copies.

    Windows of one start whose values are the same up to nine decimals are a class, and its smallest pass stands for it. A 'pair' is of two classes, from
    which windows of different passes can be taken (so both may stand at one pass, if one class has another); each further window of a class is a
    'member' beside the first, like it by 1. What is compared grows with the different windows, what is returned with their pairs and the copies.
    """
    same = F.sha2(F.array_join(F.transform("w", lambda x: F.floor(x * 1e9 + 0.5).cast("string")), ","), 256)
    p = Window.partitionBy("start", "_same")
    rows = windows.select(F.col(key).cast("long").alias(key), F.col("start").cast("long").alias("start"), "w").withColumn("_same", same)
    placed = rows.withColumns({"rep": F.min(key).over(p), "many": F.count("*").over(p) > 1})
    pairs = alike_windows(placed.where(F.col(key) == F.col("rep")), key, radius, least, **kw)
    copies = placed.where(F.col(key) != F.col("rep")).select(F.lit("member").alias("kind"), F.col("rep").alias("a"), F.col("start").alias("a_start"), F.col(key).alias("b"), F.col("start").alias("b_start"), F.lit(1.0).alias("similarity"))
    return pairs.select(F.lit("pair").alias("kind"), "a", "a_start", "b", "b_start", "similarity").unionByName(copies)


def _banded(placed: DataFrame, n: int, bands: int, planes: int) -> DataFrame:
    """Rows once for each band, with the sides of its planes that the window lies on."""
    hyper = np.random.default_rng(SEED).normal(size=(bands, planes, n))

    def sign(b: int) -> F.Column:
        total = lambda p: F.aggregate(F.zip_with("w", F.array(*[F.lit(float(x)) for x in hyper[b, p]]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return sum((F.when(total(p) > 0, 1 << p).otherwise(0) for p in range(planes)), F.lit(0))

    return placed.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), sign(b).alias("side")) for b in range(bands)]))).select(*placed.columns, "_b.*")
