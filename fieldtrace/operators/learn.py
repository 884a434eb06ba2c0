"""Reliability learning: candidate features, a leave-one-segment-out random forest, and boosted trees of all folds at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disagreement(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the mean, range and largest gap to the mean of the candidates' predictions."""
    a = F.array(*[F.col(f"`{x}`") for x in columns])
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(columns)
    out = df.withColumn("cand_mean", mean).withColumn("cand_range", F.array_max(a) - F.array_min(a))
    return out.withColumn("cand_gap", F.array_max(F.transform(a, lambda x: F.abs(x - F.col("cand_mean")))))


#: Rows of a part that forests are fitted on, and the fewest and most parts: bags are drawn by part, so parts depend on the number of rows alone.
PART_ROWS, PARTS = 20_000, (32, 1024)


#: Bins of a feature; the most cells (segment, label and bins of all features) that a forest is grown on; trees that a task grows at least.
FOREST_BINS, MOST_CELLS, TASK_TREES = 32, 200_000, 15


def leave_one_out_forest(df: DataFrame, segments: list, segment: str, label: str, features: list[str], trees: int = 300, depth: int = 5, leaf: int = 8, seed: int = 42, most_cells: int = MOST_CELLS) -> tuple[DataFrame, float]:
    """Probability of each row from a balanced forest trained on the other segments, and the area under the curve.

    ``segments`` lists the folds (a handful of named segments); a fold without both classes in training is left out; with no fold left every probability is null.

    A forest sees a feature's bin only, so rows of one segment and label whose features lie in the same bins are one cell with a count, and the
    bag of a tree, a Poisson draw for each row, is one Poisson draw of the count for each cell: the same distribution for any number of rows. All rows
    are binned and counted, and each is scored by its cell. Where there are more than ``most_cells`` cells the rows themselves go to Spark's forest.
    """
    nf = len(features)
    plain = df.na.fill(0.0, features)
    number = {c: F.col(c).cast("double") for c in features}
    shares = [i / FOREST_BINS for i in range(1, FOREST_BINS)]
    got = plain.agg(*[F.percentile_approx(number[f], F.array(*map(F.lit, shares)), F.lit(10_000)).alias(f"q{i}") for i, f in enumerate(features)]).first()
    cuts = [np.unique(np.array(got[f"q{i}"] or [], dtype=float)) for i in range(nf)]

    def code(batch: pa.RecordBatch) -> np.ndarray:
        """The bins of the last columns as one number."""
        at = np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(nf):
            at = at * FOREST_BINS + np.searchsorted(cuts[i], batch.column(batch.num_columns - nf + i).to_numpy(zero_copy_only=False), "left")
        return at

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code(batch))], names=["s", "y", "cell"])

    kind = dict(df.dtypes)[segment]
    learned = plain.where(F.col(segment).isNotNull()).select(F.col(segment).alias("s"), F.col(label).cast("int").alias("y"), *[number[f].alias(f"x{i}") for i, f in enumerate(features)])
    cells = learned.mapInArrow(coded, f"s {kind}, y int, cell long").groupBy("s", "y", "cell").count().limit(most_cells + 1).toArrow() if 0 < nf <= 12 else None
    if cells is None or cells.num_rows > most_cells:
        return _forest_of_rows(df, segments, segment, label, features, trees, depth, leaf, seed)
    cells = cells.sort_by([(c, "ascending") for c in ("s", "cell", "y")])
    own, n, at = np.array(cells["s"].to_pylist(), dtype=object), cells["count"].to_numpy(), cells["cell"].to_numpy()
    y = np.array([-1 if v is None else v for v in cells["y"].to_pylist()], dtype=np.int64)
    bins = np.stack([at // FOREST_BINS ** (nf - 1 - i) % FOREST_BINS for i in range(nf)], axis=1)
    counted = {held: np.bincount(y[use], weights=n[use], minlength=2) for held in segments for use in [(own != held) & (y >= 0)]}
    folds = [held for held, c in counted.items() if c[0] and c[1]]
    if not folds:
        return df.withColumn("prob", F.lit(None).cast("double")), float("nan")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                for k, held in enumerate(folds):
                    mine, train = own == held, (own != held) & (y >= 0)
                    c = counted[held]
                    total = np.zeros(mine.sum())
                    for tree in range(first, min(trees, first + TASK_TREES)):
                        rng = np.random.default_rng([seed, k, tree])
                        total += forest_tree(bins, y, np.where(train, rng.poisson(n), 0), c.sum() / (2 * c), depth, leaf, rng)[mine]
                    yield pa.RecordBatch.from_pydict({"fold": [k], "first": [first], "total": [total]}, pa.schema([("fold", pa.int32()), ("first", pa.int64()), ("total", pa.list_(pa.float64()))]))

    starts = df.sparkSession.range(0, trees, TASK_TREES, -(-trees // TASK_TREES))
    parts = sorted(starts.mapInArrow(grown, "fold int, first long, total array<double>").collect(), key=lambda r: (r.fold, r.first))  # added in one order
    table, points = {}, []
    for k, held in enumerate(folds):
        mine = np.flatnonzero(own == held)
        prob = np.sum([r.total for r in parts if r.fold == k], axis=0) / trees
        table[held] = at[mine], prob
        points += [(p, y[i], n[i]) for i, p in zip(mine, prob, strict=True) if y[i] >= 0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cell = np.array(batch.column(batch.num_columns - nf - 1).to_pylist(), dtype=object), code(batch)
            prob = np.full(batch.num_rows, np.nan)
            for held, (known, p) in table.items():
                rows = np.flatnonzero(names == held)
                prob[rows] = p[np.searchsorted(known, cell[rows])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: -nf - 1], pa.array(prob)], names=[*batch.schema.names[: -nf - 1], "prob"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    scored = plain.where(F.col(segment).isin(folds)).select("*", F.col(segment).alias("_s"), *[number[f].alias(f"_x{i}") for i, f in enumerate(features)])
    return scored.mapInArrow(score, f"{schema}, prob double"), area(points)


def area(points: list[tuple[float, int, int]]) -> float:
    """Area under the curve of (score, class, rows): how often a row of class 1 scores above one of class 0, equal scores by half."""
    if not points:
        return float("nan")
    score, y, n = (np.array(x) for x in zip(*points, strict=True))
    _, rank = np.unique(score, return_inverse=True)
    neg, pos = (np.bincount(rank, weights=np.where(y == c, n, 0)) for c in (0, 1))
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum())) if pos.any() and neg.any() else float("nan")


def forest_tree(bins: np.ndarray, y: np.ndarray, bag: np.ndarray, weight: np.ndarray, depth: int, leaf: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted share of class 1 in each cell's leaf of one tree of least Gini impurity, grown on ``bag`` rows of each cell (0: not learned from).

    Each node looks at the bins of a draw of the root of the number of features, rounded up, as Spark's forests do; both sides of a split hold ``leaf`` rows.
    """
    nf = bins.shape[1]
    used = np.flatnonzero(bag)
    node, out = np.zeros(len(bins), dtype=np.int64), np.zeros(len(bins))
    size, live = 1, np.ones(len(bins), dtype=bool)
    for level in range(depth + 1):
        own = used[live[used]]
        hist = np.stack([np.bincount((node[own] * FOREST_BINS + bins[own, i]) * 2 + y[own], weights=bag[own], minlength=size * FOREST_BINS * 2).reshape(size, FOREST_BINS, 2) for i in range(nf)], axis=1)
        whole = hist[:, 0].sum(axis=1) * weight
        share = whole[:, 1] / np.maximum(whole.sum(axis=1), 1e-300)
        feature, cut = np.full(size, -1), np.zeros(size, dtype=np.int64)
        if level < depth:
            left = hist.cumsum(axis=2)
            right = left[:, :, -1:] - left
            purity = lambda h: ((h * weight) ** 2).sum(axis=-1) / np.maximum((h * weight).sum(axis=-1), 1e-300)
            gain = purity(left) + purity(right) - purity(left[:, :, -1:])
            drawn = rng.random((size, nf)).argsort(axis=1).argsort(axis=1) < math.ceil(math.sqrt(nf))
            fits = (left.sum(axis=-1) >= leaf) & (right.sum(axis=-1) >= leaf) & drawn[:, :, None]
            gain = np.where(fits, gain, -np.inf).reshape(size, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(size), best] > 1e-9 * np.maximum(whole.sum(axis=1), 1e-300)
            feature[split], cut[split] = best[split] // FOREST_BINS, best[split] % FOREST_BINS
        rows = np.flatnonzero(live)
        done = rows[feature[node[rows]] < 0]
        out[done], live[done] = share[node[done]], False
        rows = rows[feature[node[rows]] >= 0]
        if not len(rows):
            break
        first = np.cumsum(feature >= 0) - 1  # the nodes of the next level, two for each that is split
        size = 2 * int((feature >= 0).sum())
        node[rows] = 2 * first[node[rows]] + (bins[rows, feature[node[rows]]] > cut[node[rows]])
    return out


def _forest_of_rows(df: DataFrame, segments: list, segment: str, label: str, features: list[str], trees: int, depth: int, leaf: int, seed: int) -> tuple[DataFrame, float]:
    """``leave_one_out_forest`` by Spark's forests."""
    # a small file is one part, and a part one task, however much work hundreds of trees are; in order, so that bags repeat
    plain = df.na.fill(0.0, features)
    number = min(PARTS[1], max(PARTS[0], df.count() // PART_ROWS))
    plain = plain.repartition(number, *features, segment, label).sortWithinPartitions(*features, segment, label)
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(plain)
    parts = []
    for held in segments:
        train = ready.where(F.col(segment) != held)
        n = train.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
        if not n["n"] or n["p"] in (0, None, n["n"]):
            continue
        weight = F.when(F.col(label) == 1, n["n"] / (2.0 * n["p"])).otherwise(n["n"] / (2.0 * (n["n"] - n["p"])))
        model = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(train.withColumn("_w", weight))
        parts.append(model.transform(ready.where(F.col(segment) == held)).withColumn("prob", vector_to_array("probability")[1]))
    if not parts:
        return df.withColumn("prob", F.lit(None).cast("double")), float("nan")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="prob").evaluate(out.withColumn(label, F.col(label).cast("double")))
    return out.drop("_x", "rawPrediction", "probability"), auc


class Tree:
    """A binary tree over bins of features: node k has the children 2 k + 1 (bin at most the cut) and 2 k + 2; feature -1 is a leaf."""

    def __init__(self, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The leaf, or the node that is not yet split, of each row."""
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            at[inner] = 2 * at[inner] + 1 + (bins[inner, f[inner]] > self.cut[at[inner]])


def best_split(hist: np.ndarray, least: int, l2: float) -> tuple[int, int, float]:
    """Feature and last bin on the left of the greatest gain, and the gain, from sums (feature, bin, (gradient, curvature, rows)); -1: none."""
    left = hist.cumsum(axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), score(left) + score(right) - score(whole), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(b), float(gain[f, b])) if gain[f, b] > 1e-9 else (-1, 0, 0.0)


def leave_one_out_trees(df: DataFrame, segment: str, label: str, features: list[str], trees: int = 10, depth: int = 3, bins: int = 32, rate: float = 0.3, least: int = 8, l2: float = 1.0) -> DataFrame:
    """``df`` with ``prob``: the probability of label 1 by boosted trees that were fitted on the rows of all other segments.

    The folds of all segments grow together: a level of all their trees is one aggregation of histograms, whose size is that of folds,
    nodes, features and bins, whatever the rows. While all folds score alike (at the first root) histograms are made by segment, and
    a fold's is all segments' less its own. Null features count as 0; a null segment is a segment; rows with a null label are scored
    but not learned from. A fold whose other rows have one class only has a null ``prob``. At most 64 segments.
    """
    names = sorted((r[0] for r in df.select(segment).distinct().limit(65).collect()), key=lambda x: (x is not None, x))
    if len(names) > 64:
        raise ValueError("more than 64 segments; group them")
    number = {x: i for i, x in enumerate(names)}
    folds, nf = len(names), len(features)
    plain = df.na.fill(0.0, features)
    shares = [i / bins for i in range(1, bins)]
    got = plain.agg(*[F.percentile_approx(F.col(f).cast("double"), F.array(*map(F.lit, shares)), F.lit(10_000)).alias(f"q{i}") for i, f in enumerate(features)]).first()
    cuts = [np.unique(np.array(got[f"q{i}"] or [], dtype=float)) for i in range(nf)]
    models: list[list[Tree]] = [[] for _ in range(folds)]
    rows = plain.select(F.col(segment).alias("s"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).persist()

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
        binned = np.stack([np.searchsorted(cuts[i], batch.column(2 + i).to_numpy(zero_copy_only=False), "left") for i in range(nf)], axis=1) if nf else np.zeros((len(own), 0), dtype=np.int64)
        return own, binned

    def histograms(frontier: list[list[int]], by_segment: bool) -> np.ndarray:
        """Sums by (fold, node of the frontier, feature, bin)."""
        size = max(map(len, frontier))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, size, nf, bins, 3))
            for batch in batches:
                own, binned = read(batch)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for fold in range(folds):
                    use = np.flatnonzero(~np.isnan(y) & ((own == fold) if by_segment else (own != fold)))
                    p = 1 / (1 + np.exp(-margin(models[fold][:-1], binned[use], rate)))
                    node = models[fold][-1].node(binned[use])
                    weights = (y[use] - p, p * (1 - p), np.ones(len(use)))
                    for at, k in enumerate(frontier[fold]):
                        here = np.flatnonzero(node == k)
                        for i in range(nf):
                            for w, values in enumerate(weights):
                                total[fold, at, i, :, w] += np.bincount(binned[use][here, i], weights=values[here], minlength=bins)
            full = np.flatnonzero(total[..., 2].ravel())
            flat = total.reshape(-1, 3)[full]
            yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(np.ascontiguousarray(flat[:, w])) for w in range(3))], names=["at", "g", "h", "n"])

        out = np.zeros((folds * size * nf * bins, 3))
        for r in rows.mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
            out[r[0]] = r[1:]
        out = out.reshape(folds, size, nf, bins, 3)
        return out.sum(axis=0, keepdims=True) - out if by_segment else out

    fit = np.ones(folds, dtype=bool)
    for t in range(trees if nf and folds else 0):
        for m in models:
            m.append(Tree(depth))
        frontier = [[0] for _ in range(folds)]
        for level in range(depth + 1):
            hist = histograms(frontier, t == 0 and level == 0)
            if t == 0 and level == 0:  # at the margin 0 a gradient is 1/2 or -1/2, so its sum tells the classes apart
                g, n = hist[:, 0, 0, :, 0].sum(axis=1), hist[:, 0, 0, :, 2].sum(axis=1)
                fit = np.abs(g) < n / 2 - 1e-9
            new: list[list[int]] = []
            for fold in range(folds):
                tree, below = models[fold][-1], []
                for at, k in enumerate(frontier[fold]):
                    own = hist[fold, at]
                    g, h, _ = own[0].sum(axis=0)
                    tree.value[k] = g / (h + l2)
                    f, b, _ = best_split(own, least, l2) if level < depth else (-1, 0, 0.0)
                    if f >= 0:
                        tree.feature[k], tree.cut[k] = f, b
                        below += [2 * k + 1, 2 * k + 2]
                new.append(below)
            frontier = new
            if not any(frontier):
                break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 2 - nf + i) for i in range(2 + nf)], names=["s", "y", *(f"x{i}" for i in range(nf))])
            own, binned = read(table)
            prob = np.full(len(own), np.nan)
            for fold in range(folds):
                mine = np.flatnonzero(own == fold)
                if fit[fold] and nf:
                    prob[mine] = 1 / (1 + np.exp(-margin(models[fold], binned[mine], rate)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: -2 - nf], pa.array(prob, pa.float64(), from_pandas=True)], names=[*batch.schema.names[: -2 - nf], "prob"])

    rows.unpersist()
    extra = {"_s": F.col(segment), "_y": F.lit(0.0), **{f"_x{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)}}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumns(extra).mapInArrow(score, f"{schema}, prob double")


def margin(trees: list[Tree], bins: np.ndarray, rate: float) -> np.ndarray:
    """Sum of the trees' values, each by the learning rate."""
    out = np.zeros(len(bins))
    for t in trees:
        out += rate * t.value[t.node(bins)]
    return out
