"""Centroid clustering of integer vectors, exact at every step.

Vectors are packed once, in the narrowest width that holds them, and written to the shared folder, so that a round reads little
and a lost executor costs no more than its tasks. A round computes squared distances as |x|^2 - 2 x.c + |c|^2, a block of
vectors at a time, with BLAS in float64. All its terms are integers, and a guard on their size keeps every partial sum below 2^53,
where float64 is exact; blocks beyond the guard are computed in 64-bit integers as differences, and blocks beyond those in
Python's integers. Each task hands on one sum and count for each centroid, which an RDD tree aggregate combines, so what meets at
the driver is a table of centroids and never grows with the vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, write_shared

#: Components of a vector, centroids and rounds of the query.
COMPONENTS, CENTROIDS, ROUNDS = 64, 40, 5
#: A component x becomes floor(SCALE * x), a power of two, so that the product is exact.
SCALE = 256
#: Vectors of a block of distances.
BLOCK_ROWS = 4096
#: Integers of two, four and eight bytes; vectors that do not fit are kept as their unscaled components.
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
_RAW = 16


def _pack(values: np.ndarray) -> list[bytes]:
    """Rows of finite doubles as bytes: scaled integers in the narrowest width; a longer, padded form holds doubles that no integer of eight bytes does."""
    n, parts = values.shape[1], [b""] * len(values)
    with np.errstate(over="ignore"):
        whole = np.floor(values * SCALE)
    size = np.abs(whole).max(axis=1, initial=0)
    least = 0.0
    for width, limit in zip(_WIDTHS, (2.0**15, 2.0**31, 2.0**62), strict=True):
        for i in np.flatnonzero((size >= least) & (size < limit)):
            parts[i] = whole[i].astype(width).tobytes()
        least = limit
    for i in np.flatnonzero(size >= least):
        parts[i] = values[i].astype("<f8").tobytes() + bytes((_RAW - 8) * n)
    return parts


def _unpack(parts: list[bytes], n: int) -> np.ndarray:
    """Rows as integers; an object array where one does not fit into eight bytes."""
    width = {len(p) for p in parts}
    if width <= {n * w.itemsize for w in _WIDTHS}:
        if len(width) == 1:
            return np.frombuffer(b"".join(parts), dtype=f"<i{width.pop() // n}").reshape(-1, n).astype(np.int64)
        return np.stack([np.frombuffer(p, dtype=f"<i{len(p) // n}").astype(np.int64) for p in parts])
    return np.array([_whole(p, n) for p in parts], dtype=object)


def _whole(part: bytes, n: int) -> list[int]:
    if len(part) == _RAW * n:  # doubles of 2^54 and more are integers
        return [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in np.frombuffer(part[: 8 * n], dtype="<f8").tolist()]
    return np.frombuffer(part, dtype=f"<i{len(part) // n}").tolist()


def pack_vectors(vectors: DataFrame, components: int, column: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors with exactly ``components`` components, none null or non-finite; the others go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(1)
            ends = np.asarray(lists.offsets, dtype=np.int64)
            flat = lists.values
            bad = np.zeros(len(flat), dtype=bool)
            if flat.null_count:
                bad |= np.asarray(flat.is_null())
            values = np.asarray(flat.fill_null(0) if flat.null_count else flat, dtype=np.float64)
            bad |= ~np.isfinite(values)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = (np.diff(ends) == components) & (wrong[ends[1:]] == wrong[ends[:-1]])
            if lists.null_count:
                good &= ~np.asarray(lists.is_null())
            rows = np.flatnonzero(good)
            at = ends[:-1][rows][:, None] + np.arange(components)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(_pack(values[at]), pa.binary())], names=["vec_id", "v"])

    two = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return map_arrow(two, run, "vec_id long, v binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller) and the squared distance to it, exactly."""
    n = x.shape[1]
    most = max(_most(x), _most(centroids))
    if 4 * n * most * most < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
        number = d.argmin(axis=1)
        return number, d[np.arange(len(x)), number].astype(np.int64)
    if 4 * n * most * most >= 1 << 63:
        x, centroids = x.astype(object), centroids.astype(object)
    best, number = None, np.zeros(len(x), dtype=np.int64)
    for k, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(axis=1)
        if best is None:
            best = d
        else:
            less = (d < best).astype(bool)
            number[less], best = k, np.where(less, d, best)
    return number, best


def _most(x: np.ndarray) -> int:
    return int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0


@dataclass
class Totals:
    """Of each centroid the number of its vectors, the sum of their components and of their squared distances, in exact integers."""

    count: list[int]
    distance: list[int]
    sums: list[list[int]]

    @classmethod
    def none(cls, k: int, n: int) -> Totals:
        return cls([0] * k, [0] * k, [[0] * n for _ in range(k)])

    def add(self, x: np.ndarray, number: np.ndarray, distance: np.ndarray) -> Totals:
        k = len(self.count)
        wide = x.dtype == object or _most(x) * max(len(x), 1) >= 1 << 53
        if wide:
            for row, c in zip(x.tolist(), number.tolist(), strict=True):
                self.sums[c] = [a + int(b) for a, b in zip(self.sums[c], row, strict=True)]
        else:
            one = (number[:, None] == np.arange(k)).astype(np.float64)
            for c, row in enumerate((one.T @ x.astype(np.float64)).astype(np.int64).tolist()):
                self.sums[c] = [a + b for a, b in zip(self.sums[c], row, strict=True)]
        for c, m in enumerate(np.bincount(number, minlength=k).tolist()):
            self.count[c] += m
        if distance.dtype != object and int(distance.max(initial=0)) * len(distance) < 1 << 53:
            own = np.bincount(number, weights=distance, minlength=k).astype(np.int64).tolist()
            self.distance = [a + b for a, b in zip(self.distance, own, strict=True)]
        else:
            for c, d in zip(number.tolist(), distance.tolist(), strict=True):
                self.distance[c] += d
        return self

    def merge(self, other: Totals) -> Totals:
        self.count = [a + b for a, b in zip(self.count, other.count, strict=True)]
        self.distance = [a + b for a, b in zip(self.distance, other.distance, strict=True)]
        self.sums = [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(self.sums, other.sums, strict=True)]
        return self


def _blocks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(at, BLOCK_ROWS)
        yield part, _unpack(part.column(1).to_pylist(), n)


def round_totals(packed: DataFrame, centroids: np.ndarray) -> Totals:
    """Totals of all vectors assigned to their nearest centroids: one sum for each task, combined by a tree."""
    k, n = centroids.shape
    shared = packed.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Totals.none(k, n)
        for batch in slices(batches):
            for _, x in _blocks(batch, n):
                total.add(x, *nearest(x, shared.value))
        text = lambda rows: pa.array([[str(v) for v in rows]], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([text(total.count), text(total.distance), text(v for row in total.sums for v in row)], names=["count", "distance", "sums"])

    def read(total: Totals, row) -> Totals:
        flat = [int(v) for v in row["sums"]]
        return total.merge(Totals([int(v) for v in row["count"]], [int(v) for v in row["distance"]], [flat[c * n : (c + 1) * n] for c in range(k)]))

    rows = packed.mapInArrow(run, "count array<string>, distance array<string>, sums array<string>").rdd
    return rows.treeAggregate(Totals.none(k, n), read, Totals.merge, depth=3)


def first_centroids(packed: DataFrame, k: int, components: int) -> np.ndarray:
    """The vectors of the ``k`` smallest digests of ``2:<vec_id>``, in that order. Null ids start none; of rows with the same id
    the smaller packed bytes come first. Fewer vectors: as many centroids."""
    rows = packed.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), "v").limit(k).collect()
    return _narrow(_unpack([bytes(r["v"]) for r in rows], components)) if rows else np.empty((0, components), dtype=np.int64)


def _narrow(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int64) if _most(rows) < 1 << 62 else rows


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, one row for each kept vector.

    Every round assigns each vector to the nearest centroid and replaces each centroid that has vectors by the floor of their
    mean, component by component; then vectors are assigned once more. Null ids are clustered but start no centroid; repeated
    rows count each. Distances and inertias beyond a long are null. No kept vector, or none with an id: no row. Other columns
    are ignored.
    """
    packed = write_shared(pack_vectors(vectors, components, column), "vectors")
    centroids = first_centroids(packed, k, components)
    if not len(centroids):
        return packed.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        total = round_totals(packed, centroids)
        mean = [[s // m for s in row] if m else old for m, row, old in zip(total.count, total.sums, centroids.tolist(), strict=True)]
        centroids = _narrow(np.array(mean, dtype=object))
    total = round_totals(packed, centroids)
    long = lambda v: v if v < 1 << 63 else None
    inertia, own = long(sum(total.distance)), [long(v) for v in total.distance]
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    shared = packed.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for part, x in _blocks(batch, components):
                number, distance = nearest(x, shared.value)
                at = number.tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(at, pa.int32()), pa.array([long(v) for v in distance.tolist()], pa.int64()), pa.array([own[c] for c in at], pa.int64()),
                     pa.array([inertia] * len(at), pa.int64()), pa.array([digests[c] for c in at], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return map_arrow(packed, run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, column: str = "embedding") -> str:
    """``cluster_vectors`` in DuckDB: one row for each component, products joined by component, sums in HUGEINT."""
    steps = [f"""x AS MATERIALIZED (SELECT r, vec_id, unnest(range({components})) AS j, unnest([CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) for e in {column}]) AS x
      FROM (SELECT row_number() OVER () AS r, vec_id, {column} FROM embeddings WHERE len({column}) = {components} AND len([e for e in {column} if e IS NOT NULL AND isfinite(e)]) = {components})),
    s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT r, vec_id FROM x WHERE vec_id IS NOT NULL) ORDER BY sha256('2:' || vec_id) LIMIT {k}),
    c0 AS MATERIALIZED (SELECT c, j, x AS y FROM s JOIN x USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM
      (SELECT r, c, sum(CAST(x - y AS HUGEINT) * (x - y)) AS d FROM x JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, j, sum(CAST(x AS HUGEINT)) AS t, CAST(count(*) AS HUGEINT) AS n FROM a{i} JOIN x USING (r) GROUP BY c, j),
    c{i + 1} AS MATERIALIZED (SELECT c, j, CAST(coalesce((t - ((t % n) + n) % n) // n, y) AS BIGINT) AS y FROM c{i} LEFT JOIN m{i} USING (c, j))""")
    last = f"a{rounds}"
    return f"""WITH {', '.join(steps)},
    h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
    i AS (SELECT c, sum(d) AS own FROM {last} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia,
      CAST((SELECT sum(d) FROM {last}) AS BIGINT) AS inertia, centroid_sha256
    FROM {last} JOIN (SELECT DISTINCT r, vec_id FROM x) USING (r) JOIN h USING (c) JOIN i USING (c)"""
