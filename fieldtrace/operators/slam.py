"""Graph SLAM on one track's passes: nodes with signatures, drifting odometry, loop closures, pose graph.

Nodes are made by array expressions, pass by pass. A run is one track with one configuration, a grouped kernel: its nodes are
those of one survey, and tracks and configurations run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import kernels

# The runs' configurations (odometry scale and noise, loop threshold, gradient in the signatures, robust weights).
RUNS = {
    "odometry_only": {"bias": 0.02, "noise": 0.35, "threshold": 2.0}, "total_strict": {"bias": 0.02, "noise": 0.35, "threshold": 0.97}, "total_loose": {"bias": 0.02, "noise": 0.35, "threshold": 0.9},
    "gradient": {"bias": 0.02, "noise": 0.35, "threshold": 0.9, "grad": True}, "plain_weights": {"bias": 0.02, "noise": 0.35, "threshold": 0.9, "robust": False},
}


def build_nodes(passes: DataFrame, spacing: int, length: int, share: float = 0.95) -> DataFrame:
    """(pass, direction, c array, q array) -> pass, k, s, sig, grad: nodes every ``spacing`` cells with the ``length`` cells before them in travel direction.

    Signatures are smoothed by three points and standardised; ``grad`` is that of their steps. A node needs ``share`` of its cells.
    """
    rows = passes.withColumn("way", F.when(F.col("direction") > 0, F.col("q")).otherwise(F.reverse("q"))).withColumn("pos", F.when(F.col("direction") > 0, F.col("c")).otherwise(F.reverse("c")))
    rows = rows.withColumn("smooth", arrays.rolling_median(F.col("way"), 1, 1))
    at = F.sequence(F.lit(length - 1), F.size("smooth") - 1, F.lit(spacing))
    rows = rows.where(F.size("smooth") >= length).select("pass", "pos", "smooth", F.posexplode(at).alias("k", "i"))
    sig = F.slice("smooth", F.col("i") - length + 2, length)
    rows = rows.withColumn("raw", sig).where(F.size(arrays.present(F.col("raw"))) >= share * length)
    steps = F.transform(F.sequence(F.lit(1), F.lit(length - 1)), lambda j: F.get("raw", j) - F.get("raw", j - 1))
    return rows.select("pass", F.col("k").cast("long").alias("k"), F.get("pos", F.col("i")).alias("s"), arrays.standardise(F.col("raw"), 1e-9).alias("sig"), arrays.standardise(steps, 1e-9).alias("grad"))


def odometry(true_s: np.ndarray, bias: float, noise: float, seed: int) -> np.ndarray:
    """Positions summed from steps with a scale error and noise; the seed is the run's, so runs repeat."""
    steps = np.diff(true_s)
    drift = steps * (1 + bias) + np.random.default_rng(seed).normal(0, noise, len(steps))
    return np.concatenate([true_s[:1], true_s[0] + np.cumsum(drift)])


def similarity(sig: np.ndarray, grad: np.ndarray, i: int, js: np.ndarray, use_grad: bool) -> np.ndarray:
    """Correlation of node ``i``'s signature with those of ``js``; with the gradient, the mean of both correlations."""
    out = sig[js] @ sig[i] / sig.shape[1]
    return (out + grad[js] @ grad[i] / grad.shape[1]) / 2 if use_grad else out


def detect_loops(passes: np.ndarray, odom: np.ndarray, sig: np.ndarray, grad: np.ndarray, threshold: float, radius: float = 140.0, use_grad: bool = False, apart: int = 3, margin: float = -np.inf) -> list[tuple[int, int, float]]:
    """(i, j, score) of each node's best earlier node of another pass, more than ``apart`` nodes back and within ``radius`` by odometry."""
    out = []
    for i in range(len(passes)):
        js = np.flatnonzero((passes[: max(0, i - apart)] != passes[i]) & (np.abs(odom[: max(0, i - apart)] - odom[i]) <= radius))
        if len(js):
            score = similarity(sig, grad, i, js, use_grad)
            order = np.argsort(-score, kind="stable")
            if score[order[0]] >= threshold and (len(js) == 1 or score[order[0]] - score[order[1]] >= margin):
                out.append((i, int(js[order[0]]), float(score[order[0]])))
    return out


def run_tracks(nodes: DataFrame, track: str, configs: dict[str, dict], loop_sigma: float = 1.0, odom_sigma: float = 0.5) -> DataFrame:
    """Per track and configuration: nodes, loops, loops over 2 m off, and RMSE of odometry and of the solved graph.

    A loop says that two nodes are at one place (a measurement of 0 m), whatever the truth.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pass", "k"], kind="stable")
        name = pdf["config"].iloc[0]
        cfg = configs[name]
        true_s, sig, grad = pdf["s"].to_numpy(dtype=float), np.stack(pdf["sig"]), np.stack(pdf["grad"])
        odom = odometry(true_s, cfg["bias"], cfg["noise"], int(pdf[track].iloc[0]))
        loops = detect_loops(pdf["pass"].to_numpy(), odom, sig, grad, cfg["threshold"], use_grad=cfg.get("grad", False))
        solved = kernels.pose_graph(odom, [(j, i, 0.0) for i, j, _ in loops], odom_sigma, loop_sigma, cfg.get("robust", True))
        off = [abs(true_s[i] - true_s[j]) > 2.0 for i, j, _ in loops]
        rmse = lambda x: float(np.sqrt(np.mean((x - true_s) ** 2)))
        return pd.DataFrame({track: [pdf[track].iloc[0]], "config": [name], "nodes": [len(pdf)], "loops": [len(loops)], "false_loops": [int(sum(off))], "odometry_rmse": [rmse(odom)], "rmse": [rmse(solved)]})

    rows = nodes.where("sig is not null and grad is not null").withColumn("config", F.explode(F.array(*[F.lit(k) for k in configs])))
    return rows.groupBy(track, "config").applyInPandas(run, f"{track} long, config string, nodes long, loops long, false_loops long, odometry_rmse double, rmse double")
