"""Named families of tracker configurations, and their summary over passes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import localize

# Uniqueness gates as (exclusion in metres, least scale, offset, span), and speed bounds in metres a second.
EXCLUDE = 5.0
GATES = {"hard": (EXCLUDE, 0.12, 0.03, 0.20), "mid": (EXCLUDE, 0.30, 0.02, 0.24), "soft": (EXCLUDE, 0.45, 0.0, 0.18)}
RANK_GATE = (40, 0.15, 0.02, 0.12)
BOUNDS = (0.8, 1.0, 1.2, 1.4, 1.6)
SMOOTH = 0.025


def _base(**kw) -> dict:
    return {"vmax": 1.4, "smooth": SMOOTH, "mode": "greedy"} | kw


def hmm() -> dict[str, dict]:
    """Three noise levels without and with each gate, and a speed prior."""
    out = {f"sigma_{s}{'_' + g if g else ''}": _base(sigma=s, **({"gate": GATES[g]} if g else {})) for s in (1.2, 1.25, 1.35) for g in (None, *GATES)}
    return out | {"speed_prior": _base(sigma=1.2, speed_weight=1.0)}


def forward_anchor(start: float) -> dict[str, dict]:
    """Speed bounds with and without a prior on the start; gates; speed priors."""
    out = {f"vmax_{v}{'_start' if prior else ''}": _base(vmax=v, **({"start": (start, 80.0)} if prior else {})) for v in BOUNDS for prior in (False, True)}
    out |= {f"gate_{k}": _base(gate=g) for k, g in GATES.items()}
    return out | {f"speed_{w}": _base(speed_weight=w) for w in (0.02, 0.04, 0.08)}


def endpoint(start: float) -> dict[str, dict]:
    """Uniform and end-point starts under four speed bounds."""
    return {f"{'end' if prior else 'uniform'}_{v}": _base(vmax=v, **({"start": (start, 80.0)} if prior else {})) for v in (1.0, 1.2, 1.4, 1.6) for prior in (False, True)}


def coarse_start() -> dict[str, dict]:
    """Starts known to some metres (from the truth: an upper bound), speed bounds, lags."""
    return {f"sigma_{s}_vmax_{v}_lag_{k}": {"start": ("truth", float(s)), "vmax": v, "lag": k} for s in (30, 60, 100) for v in (1.0, 1.2, 1.4) for k in (0, 5, 15)}


def fixed_lag() -> dict[str, dict]:
    bases = {"plain": {}, "gated": {"gate": GATES["mid"]}, "slow": {"vmax": 1.0}, "gaussian": {"robust": False}}
    return {f"{name}_lag_{k}": {"vmax": 1.4, "lag": k} | kw for name, kw in bases.items() for k in (0, 5, 15)}


def sequence() -> dict[str, dict]:
    """Windows of single-sample and sequence likelihood."""
    return {f"window_{w}_{k:g}": _base(sequence=(float(w), 4.0, k), direction=1) for w, k in ((10, 0.35), (15, 0.35), (20, 0.35), (15, 0.0), (20, 1.0))}


def filters() -> dict[str, dict]:
    """Particle filters and bounded paths on the same map."""
    return {
        "pf": {"method": "particle", "vmax": 1.2}, "pf_gaussian": {"method": "particle", "vmax": 1.2, "robust": False}, "viterbi": _base(vmax=1.2, robust=False), "viterbi_robust": _base(vmax=1.2),
        "viterbi_rank_gate": _base(vmax=1.2, rank_gate=RANK_GATE),
    }


def motion() -> dict[str, dict]:
    """Turning, signed steps, turns at a known row, and signed steps after it."""
    out = {f"switch_{p:g}": {"method": "switching", "vmax": 1.4, "switch": p, "edge": 0.5, "smooth": SMOOTH} for p in (2.0, 4.0, 8.0, 16.0)} | {"switch_opposite": {"method": "switching", "vmax": 1.4, "switch": 8.0, "opposite_start": 4.0}}
    out |= {f"signed_{s}_{w}": {"vmax": 1.6, "step_scale": s, "step_sigma": 0.8, "step_weight": w} for s in (0.8, 1.0, 1.2) for w in (0.5, 1.0)}
    out |= {"pieces": {"vmax": 1.4, "pieces": 35, "smooth": SMOOTH}, "pieces_late": {"vmax": 1.4, "pieces": 45, "smooth": SMOOTH}}
    return out | {f"suffix_{s}_{w}": {"vmax": 1.4, "suffix": 35, "step_scale": s, "step_sigma": 0.8, "step_weight": w} for s in (0.8, 1.0, 1.2) for w in (0.5, 1.0)}


def speed_scales(scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5)) -> dict[str, dict]:
    """A speed prior under several scales of the measured speed; the scale is the configuration's name."""
    return {f"{s:g}": _base(mode="exact", speed_weight=1.0, speed_scale=s) for s in scales}


#: How a hypothesis is scored, by name; columns as localize.hypotheses has them.
SCORE_MODES = {"sum": "score", "per_sample": "per_sample", "median": "median", "trim20": "trim20", "trim35": "trim35", "p10": "p10", "hybrid": "0.35 * per_sample + 0.65 * trim20"}


def choose_hypotheses(found: DataFrame, *keys: str) -> DataFrame:
    """Under each score mode the hypothesis of each pass (or of each of the keys) with the greatest score, the first of equal ones: keys, mode, place, median_abs."""
    keys = keys or ("pass",)
    picks = [F.struct(F.lit(name).alias("mode"), F.max_by(F.struct("place", "median_abs"), F.struct(F.expr(rule).alias("s"), (-F.col("place")).alias("p"))).alias("h")) for name, rule in SCORE_MODES.items()]
    rows = found.groupBy(*keys).agg(F.array(*picks).alias("_p")).select(*keys, F.explode("_p").alias("t"))
    return rows.select(*keys, "t.mode", "t.h.place", "t.h.median_abs")


def per_pass(passes: DataFrame, dist: np.ndarray, ref: np.ndarray, configs: dict[str, dict]) -> DataFrame:
    """Metrics of each pass under each configuration: pass, config, median_abs, rmse, score."""
    rows = localize.track(passes, dist, ref, configs).withColumn("e", F.col("pred") - F.col("truth"))
    return rows.groupBy("pass", "config").agg(stats.median(F.abs("e")).alias("median_abs"), stats.rmse("e").alias("rmse"), F.first("score").alias("score"))


def summary(metrics: DataFrame, *keys: str) -> DataFrame:
    """Per configuration: passes, median and mean of their medians, mean RMSE, worst median."""
    return metrics.groupBy(*keys, "config").agg(
        F.count("*").alias("passes"), stats.median("median_abs").alias("median"), F.avg("median_abs").alias("mean"), F.avg("rmse").alias("rmse"), F.max("median_abs").alias("worst")
    )


def scale_posterior(metrics: DataFrame, key: str, scale: str, score: str, lambdas: list[float]) -> DataFrame:
    """The scale of each key by score less lambda times its squared logarithm, for each lambda, beside the scale of the least error. First of equal ones (scores: up to nine decimals): the smaller."""
    picks = [F.max(F.struct(F.floor((F.col(score) - lam * F.log(scale) ** 2) * 1e9 + 0.5).alias("s"), (-F.col(scale)).alias("k"))).alias(f"_{i}") for i, lam in enumerate(lambdas)]
    rows = metrics.groupBy(key).agg(F.min(F.struct("median_abs", scale)).alias("_best"), *picks)
    return rows.select(key, F.col(f"_best.{scale}").alias("oracle"), *[(-F.col(f"_{i}.k")).alias(f"lambda_{lam:g}") for i, lam in enumerate(lambdas)])
