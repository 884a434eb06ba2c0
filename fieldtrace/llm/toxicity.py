"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - cut[k]): one weight vector serves all ordered cuts, and the expected severity is the sum of
these probabilities. Features are counts of words and of word beginnings, hashed; the ones kept are those whose presence
differs most between labelled toxic and other texts. Labels are 0 or 1, so grades of toxic texts come from how many telling
words they hold: thirds of that number are grades 1 to 3, other texts are grade 0. So severity measures how much telling
vocabulary a text holds; it is no judgement that annotators made. Copies and near copies among the labelled
texts (equal least shingle hash and label) count once, or their ordinary words would pass for telling ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shingle_hashes, slices, write_shared
from .quality import training_ids

#: Labelled rows used for fitting at most, and hashed features kept at most (README).
TRAIN_ROWS, KEPT = 20_000, 512
SPACE = 1 << 22
GRADES = 3
CACHE_TOKENS = 100_000
_STRIP = " \t\r\n\v\f.,;:!?\"'()[]{}<>|*#$%&-_/\\«»„“”"


def token_features(token: str) -> tuple[int, ...]:
    """Hashed features of one white-space-separated token: the lower-cased word and its first four and five letters."""
    word = token.lower().strip(_STRIP)
    if not word:
        return ()
    names = ["w" + word] + [f"{k}{word[:k]}" for k in (4, 5) if len(word) > k]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % SPACE for n in names)


class Featurizer:
    """Counts of kept features per text; the features of tokens seen are cached up to CACHE_TOKENS."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        self.place = None if kept is None else {int(f): i for i, f in enumerate(kept)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _of(self, token: str) -> tuple[int, ...]:
        got = self.cache.get(token)
        if got is None:
            got = token_features(token)
            if self.place is not None:
                got = tuple(self.place[f] for f in got if f in self.place)
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            self.cache[token] = got
        return got

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Feature counts and the number of tokens."""
        tokens = (text or "").split()
        out: dict[int, int] = {}
        for token, n in Counter(tokens).items():
            for f in self._of(token):
                out[f] = out.get(f, 0) + n
        return out, len(tokens)


@dataclass
class OrdinalModel:
    kept: np.ndarray  # hashed features in the order of the weights
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one for each grade above 0

    def probabilities(self, rows: list[dict[int, int]]) -> np.ndarray:
        """(texts, GRADES) probabilities of reaching grade 1, 2, ..."""
        z = np.array([sum(self.weights[f] * np.log1p(n) for f, n in r.items()) for r in rows])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -30, 30)))


def fit_ordinal(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, steps: int = 800, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by Adam on the mean negative log-likelihood; features as (row, column, value) triples."""
    n = len(grade)
    w = np.zeros(size)
    share = np.clip([(grade > k).mean() for k in range(GRADES)], 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])  # first cut, then logs of the gaps
    m1, m2 = np.zeros(size + GRADES), np.zeros(size + GRADES)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    for step in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, w[feature] * value, n)
        above = np.concatenate([np.ones((n, 1)), sig(z[:, None] - cuts[None, :]), np.zeros((n, 1))], axis=1)  # P(grade >= k)
        rows = np.arange(n)
        upper, lower = above[rows, grade], above[rows, grade + 1]
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        dz = -(du - dl) / mass / n
        dcuts = np.zeros(GRADES)
        for k in range(GRADES):
            dcuts[k] = (np.where(grade == k + 1, du, 0) - np.where(grade == k, dl, 0)).dot(1 / mass) / n
        tail = np.cumsum(dcuts[::-1])[::-1]
        grad = np.concatenate([np.bincount(feature, dz[owner] * value, size) + l2 * w, [tail[0]], tail[1:] * gaps])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w -= move[:size]
        raw -= move[size:]
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    ids = training_ids(labels, "toxic", rows)  # bounded by ``rows``, so broadcast
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            least = [int(s.min().view(np.int64)) if len(s) else 0 for s in shingle_hashes(batch.column(2).to_pylist(), 3, lower=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "y", "text", "least"])

    keyed = map_arrow(named.select("doc_id", "y", "text"), key, "doc_id long, y int, text string, least long")
    return keyed.groupBy("least", "y").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("y", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, kept: int = KEPT) -> OrdinalModel:
    """Model from at most ``rows`` labelled texts. No toxic label: a model that gives every text a severity near 0."""
    sample = write_shared(_labelled(docs, labels, rows), "toxicity-sample")  # read three times

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Featurizer(), (Counter(), Counter())
        texts = [0, 0]
        for batch in slices(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(make.counts(text)[0].keys())
                texts[y] += 1
        keys = [-1, *(set(seen[0]) | set(seen[1]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([texts[0], *(seen[0][k] for k in keys[1:])], pa.int64()), pa.array([texts[1], *(seen[1][k] for k in keys[1:])], pa.int64())],
            names=["f", "other", "toxic"],
        )

    table = map_arrow(sample, presence, "f long, other long, toxic long").groupBy("f").agg(F.sum("other").alias("a"), F.sum("toxic").alias("b"))
    total = table.where("f = -1").first()
    n0, n1 = (total["a"], total["b"]) if total else (0, 0)
    empty = OrdinalModel(np.empty(0, np.int64), np.zeros(0), np.array([8.0, 9.0, 10.0]))
    if not n1:
        return empty
    # z of the log odds ratio of presence, with a prior count; features of three texts and more
    odds = F.log((F.col("b") + 0.5) / (n1 + 0.5 - F.col("b") + 0.5)) - F.log((F.col("a") + 0.5) / (n0 + 0.5 - F.col("a") + 0.5))
    z = odds / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("a") + 0.5))
    top = table.where("f >= 0 and a + b >= 3").select("f", z.alias("z")).orderBy(F.abs("z").desc(), "f").limit(kept).collect()
    if not top:
        return empty
    features, strength = np.array([r["f"] for r in top], dtype=np.int64), np.array([r["z"] for r in top])
    telling = set(np.flatnonzero(strength > 3).tolist())

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(features)
        for batch in slices(batches):
            rows_ = [make.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(r) for r, _ in rows_], pa.list_(pa.int32())), pa.array([list(r.values()) for r, _ in rows_], pa.list_(pa.int32())), pa.array([n for _, n in rows_], pa.int32())],
                names=["y", "f", "n", "size"],
            )

    got = sorted(map_arrow(sample, sparse, "y int, f array<int>, n array<int>, size int").toArrow().to_pylist(), key=lambda r: (r["y"], r["size"], sorted(zip(r["f"], r["n"], strict=True))))
    y = np.array([r["y"] for r in got])
    hits = np.array([sum(n for f, n in zip(r["f"], r["n"], strict=True) if f in telling) for r in got])
    limits = np.quantile(hits[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + np.searchsorted(limits, hits, side="left"), 0)
    owner = np.repeat(np.arange(len(got)), [len(r["f"]) for r in got])
    feature = np.array([f for r in got for f in r["f"]], dtype=np.int64)
    value = np.log1p(np.array([n for r in got for n in r["n"]], dtype=np.float64))
    weights, cuts = fit_ordinal(owner, feature, value, grade, len(features))
    return OrdinalModel(features, weights, cuts)


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` of every whole text: expected grade (0 to 3), P(grade >= 1), and whether it is 0.5 or more.

    One row per input row; null texts count as empty. Null ids and repeated rows are kept, other columns ignored. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(model.kept)
        for batch in slices(batches):
            p = model.probabilities([make.counts(t)[0] for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))], names=["doc_id", "severity", "p_toxic", "toxic"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, severity double, p_toxic double, toxic int")


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are not scored toxic.

    Null texts count as empty and stay. Null ids and repeated rows are judged row by row; columns may have any names. An empty
    table gives an empty result; without a toxic label every row stays.
    """
    model = fit_toxicity(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(model.kept)
        for batch in slices(batches):
            p = model.probabilities([make.counts(t)[0] for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield batch.filter(pa.array(p[:, 0] < 0.5))

    return map_arrow(docs, run, docs.schema)
