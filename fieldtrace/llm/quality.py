"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed by numpy, one text at a time. The trees are grown level by level from gradient histograms over
quantile bins, then flattened into arrays (feature, threshold, leaf value, in heap order) that numpy walks for all rows at
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, slices, text_blocks, word_hashes

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_word", "upper", "digit", "punct", "symbol", "space", "high_byte", "exclaim", "bar",
    "log_lines", "mean_line", "dup_lines", "short_lines", "unique_words", "top_word", "adjacent", "repeat_trigrams", "end_marks", "words_per_mark", "byte_entropy", "first_upper",
)
#: Labelled rows used for fitting at most, taken in the order of a hash of their ids.
TRAIN_ROWS = 20_000
_CLASS = np.zeros(256, dtype=np.int64)
for _name, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b",;:'\"()-?/", b"#*$%&<>=_~^@+\\{}[]", b" \t\r\n\v\f", bytes(range(128, 256)), b"!", b"|", b"."), start=1):
    _CLASS[list(_bytes)] = _name


def text_statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES) float64; null and empty texts have zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in text_blocks(texts):
        hashes, first = word_hashes(texts[a:b], lower=True)
        for i in range(a, b):
            text = texts[i]
            if text:
                out[i] = _one(text, hashes[first[i - a] : first[i - a + 1]])
    return out


def _one(text: str, words: np.ndarray) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    kind = np.bincount(_CLASS, weights=by_byte, minlength=10)
    size, n = len(raw), len(words)
    share = by_byte[by_byte > 0] / size
    lines = [x for x in text.split("\n") if x.strip()]
    starts = np.flatnonzero((raw[1:] > 32) & (raw[:-1] <= 32)) + 1 if size > 1 else np.empty(0, dtype=np.int64)
    capital = ((raw[starts] >= 65) & (raw[starts] <= 90)).mean() if len(starts) else 0.0
    longest = np.diff(np.flatnonzero(np.concatenate([[True], raw <= 32, [True]]))).max() - 1
    unique = top = adjacent = repeated = 0.0
    if n:
        ordered = np.sort(words)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        runs = np.diff(edges)
        unique, top = len(runs) / n, runs.max() / n
        adjacent = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    if n > 2:
        with np.errstate(over="ignore"):
            grams = np.sort(mix64(words[:-2] * np.uint64(3) + mix64(words[1:-1] * np.uint64(5) + mix64(words[2:]))))
        repeated = 1 - (np.count_nonzero(grams[1:] != grams[:-1]) + 1) / len(grams)
    marks = kind[9] + kind[7]
    return [
        np.log1p(size), np.log1p(n), (size - kind[5]) / max(n, 1), np.log1p(longest), *(kind[[1, 2, 3, 4, 5, 6, 7, 8]] / size),
        np.log1p(len(lines)), np.log1p(size / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), sum(len(x) < 20 for x in lines) / max(len(lines), 1),
        unique, top, adjacent, repeated, marks / max(n, 1), np.log1p(n / (marks + 1)), float(-(share * np.log2(share)).sum()), capital,
    ]


@dataclass
class FlatTrees:
    """Complete binary trees of one depth as arrays; inner node i has children 2i+1 and 2i+2."""

    depth: int
    bias: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``x``."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> FlatTrees:
    """Histogram gradient boosting with the logistic loss. No row: score 0.5; one class: a constant near it."""
    rate_of_one = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate_of_one / (1 - rate_of_one)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    flat = FlatTrees(depth, bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return flat
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), bias)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            at = node - base
            best = np.full(width, 1e-9)
            split_f, split_b = np.zeros(width, np.int64), np.full(width, -1)
            for j in range(x.shape[1]):
                key = at * bins + code[:, j]
                gs = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                b = gain[:, : len(edges[j])].argmax(axis=1) if len(edges[j]) else np.zeros(width, np.int64)
                top = gain[np.arange(width), b] if len(edges[j]) else np.zeros(width)
                won = top > best
                best[won], split_f[won], split_b[won] = top[won], j, b[won]
            for k in range(width):
                if split_b[k] >= 0:
                    f[base + k], t[base + k] = split_f[k], edges[split_f[k]][split_b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        raw += v[leaf]
        feature.append(f), threshold.append(t), value.append(v)
    return FlatTrees(depth, bias, np.stack(feature), np.stack(threshold), np.stack(value))


def held_out(key: str = "doc_id"):
    """Rows whose labels no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out third, in the order of a hash of the id. Ids with two different labels drop out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("y2"))
        .where("y = y2")
        .select("doc_id", F.col("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def _statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = text_statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text"), "y"), run, "doc_id long, y int, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **params) -> FlatTrees:
    """Trees fitted on at most ``rows`` labelled texts, one for each id (the least statistics where its rows differ); only the statistics reach the driver."""
    ids = training_ids(labels, "quality", rows)  # at most ``rows`` rows: small enough to broadcast whatever the tables' size
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    got = _statistics(named).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").to_pylist(), dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the order in which tasks end must not matter
    return fit_trees(x[order], y[order], **params)


def score_quality(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, one row per input row.

    Null texts count as empty and get the score of all-zero statistics. Null ids and repeated rows are kept. Other
    columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.scores(text_statistics(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores at least 0.5.

    Null texts count as empty. Null ids and repeated rows are judged row by row; columns may have any names. An empty table gives
    an empty result; without labels the score is 0.5 and every row stays.
    """
    model = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.scores(text_statistics(batch.column(batch.schema.get_field_index("text")).to_pylist()))
            yield batch.filter(pa.array(s >= 0.5))

    return map_arrow(docs, run, docs.schema)
