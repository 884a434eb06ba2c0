"""Queries of the tracker families, hypotheses, sequence likelihoods, SLAM, warps of left-out passes and confidence features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays, stats
from ..functions.scalars import det_round, log_likelihood
from ..operators import features, localize, maps, matching, slam, sweeps
from .matching import RFM, _laid, _reference, _sets
from .registry import GRID, SERIES, grid, query, r, series
from .results import RES, res, rounded
from .tracks import _windows


def _map(spark, sf):
    """The median map and its scale."""
    dist, ref = localize.check_reference(maps.reference(grid(spark, sf), smooth_points=5), "cell", "v")
    return dist, ref, float(np.std(ref)) or 1.0


def _passes(spark, sf, scale):
    vel = 1.0 + (F.col("event_id") % 7 - 3) / 10.0
    return series(spark, sf).select("pass", "idx", (F.col("v") / scale).alias("obs"), (F.col("idx") % 48).cast("double").alias("truth"), vel.alias("vel"), F.abs(vel).alias("speed"), F.col("idx").cast("double").alias("travelled"))


def _sweep(spark, sf, configs):
    dist, ref, scale = _map(spark, sf)
    got = sweeps.summary(sweeps.per_pass(_passes(spark, sf, scale), dist, ref / scale, configs))
    return rounded(got, ["config", "passes"], "median", "mean", "rmse", "worst", digits=4)


@query()
def e31_hmm_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.hmm())


@query()
def e32_forward_anchor_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.forward_anchor(0.0))


@query()
def e34_v22_endpoint_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.endpoint(0.0))


@query()
def e35_coarse_start_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.coarse_start())


@query()
def v18_v19_fixed_lag_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.fixed_lag())


@query()
def v7_v8_v9_v10_sequence_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.sequence())


@query()
def v4_v6_e28_filter_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.filters())


@query()
def v20_v21_v23_v24_motion_sweep(spark, sf):
    return _sweep(spark, sf, sweeps.motion())


@query()
def v15_v17_hypothesis_sweep(spark, sf):
    """Hypotheses held over two warm-ups, chosen by each score mode."""
    dist, ref, scale = _map(spark, sf)
    found = localize.hypotheses_of(_passes(spark, sf, scale), dist, ref / scale, [20, 40], separation=8.0)
    out = sweeps.choose_hypotheses(found, "warmup", "pass")
    return out.groupBy("warmup", "mode").agg(F.count("*").alias("passes"), det_round(stats.median("median_abs"), 4).alias("median"), det_round(F.avg("median_abs"), 4).alias("mean"))


@query()
def v16_candidate_paths(spark, sf):
    """Every separated hypothesis of each pass with the scores of its path."""
    dist, ref, scale = _map(spark, sf)
    got = localize.hypotheses(_passes(spark, sf, scale), dist, ref / scale, 20, separation=8.0)
    return rounded(got, ["pass", "place"], "score", "per_sample", "median", "p10", "trim20", "trim35", "median_abs", digits=4)


@query()
def v11_v12_scale_posterior(spark, sf):
    """The scale of the measured speed by the tracks' scores, under several prior weights."""
    dist, ref, scale = _map(spark, sf)
    got = sweeps.per_pass(_passes(spark, sf, scale), dist, ref / scale, sweeps.speed_scales()).withColumn("scale", F.col("config").cast("double"))
    return sweeps.scale_posterior(got, "pass", "scale", "score", [0.0, 0.5, 2.0, 5.0, 10.0])


SCALED = f"{RES}, k AS (SELECT segment, (id % 5 + 2) / 4.0 AS scale, max(margin) AS score, median(abs(err)) AS median_abs FROM res GROUP BY ALL)"


@query(f"WITH {SCALED} SELECT segment, arg_min(scale, (median_abs, scale)) AS oracle, " + ", ".join(f"arg_max(scale, (floor((score - {lam} * ln(scale) ** 2) * 1e9 + 0.5), -scale)) AS lambda_{lam:g}" for lam in (0, 0.5, 2, 5, 10)).replace("lambda_0.5", '"lambda_0.5"') + " FROM k GROUP BY segment")
def v12_scale_selection(spark, sf):
    k = res(spark, sf).groupBy("segment", ((F.col("id") % 5 + 2) / 4.0).alias("scale")).agg(F.max("margin").alias("score"), stats.median(F.abs("err")).alias("median_abs"))
    return sweeps.scale_posterior(k, "segment", "scale", "score", [0, 0.5, 2, 5, 10])


@query()
def e33_anchor_reference_sweep(spark, sf):
    """Each named set's map under four configurations."""
    family = features.reference_family(grid(spark, sf), _sets(spark, sf))
    configs = {k: v for k, v in sweeps.endpoint(0.0).items() if k.endswith(("1.2", "1.4"))}
    out = None
    for name in ("all", "even", "first_half", "odd", "third"):  # five maps of one track, each checked for size
        dist, ref = localize.check_reference(family.where(F.col("name") == name), "cell", "v")
        scale = float(np.std(ref)) or 1.0
        got = sweeps.per_pass(_passes(spark, sf, scale), dist, ref / scale, configs).withColumn("reference", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return rounded(sweeps.summary(out, "reference"), ["reference", "config", "passes"], "median", "mean", "rmse", "worst", digits=4)


@query()
def e27_quality_map_tracks(spark, sf):
    """Three configurations on the maps gated and weighted by quality."""
    g = grid(spark, sf)
    q = g.groupBy("pass").agg((F.abs(F.avg("v") - 60) / 5).alias("e"), (0.3 + (F.first("pass") % 9) / 10.0).alias("sc"))
    configs = {k: v for k, v in sweeps.filters().items() if k.startswith("viterbi")}
    out = None
    for name, made in zip(("hard", "soft"), maps.quality_references(g, q, "e", "sc"), strict=True):
        dist, ref = localize.check_reference(made, "cell", name)
        if len(ref) < 2:
            continue
        scale = float(np.std(ref)) or 1.0
        got = sweeps.per_pass(_passes(spark, sf, scale), dist, ref / scale, configs).withColumn("reference", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return rounded(sweeps.summary(out, "reference"), ["reference", "config", "passes"], "median", "mean", "rmse", "worst", digits=4)


@query()
def e26_left_out_tracks(spark, sf):
    """Each pass tracked on the map of all others."""
    dist, _, scale = _map(spark, sf)
    own = matching.without_own(grid(spark, sf)).select("pass", F.transform("ref", lambda x: x / scale).alias("ref"))
    configs = {"viterbi": sweeps.filters()["viterbi"], "viterbi_rank_gate": sweeps.filters()["viterbi_rank_gate"]}
    passes = _passes(spark, sf, scale).join(own, "pass").withColumn("ref", F.when(F.col("idx") == 0, F.col("ref")))  # a map moves once
    got = localize.track_on_own(passes, configs).withColumn("e", F.col("pred") - F.col("truth"))
    per = got.groupBy("pass", "config").agg(stats.median(F.abs("e")).alias("median_abs"), stats.rmse("e").alias("rmse"))
    return rounded(sweeps.summary(per), ["config", "passes"], "median", "mean", "rmse", "worst", digits=4)


@query()
def v5_e30_window_viterbi(spark, sf):
    """Windows placed by steps with a Gaussian prior."""
    q, _ = _windows(spark, sf)
    dist, ref, _ = _map(spark, sf)
    z = (ref - ref.mean()) / ref.std()
    return rounded(localize.place_windows(q, dist, z, jump=3), ["pass", "start", "pred"], "score", digits=4)


@query()
def e29_window_baselines(spark, sf):
    """Warping and step Viterbi of the same windows, summarised."""
    q, _ = _windows(spark, sf)
    dist, ref, _ = _map(spark, sf)
    z = (ref - ref.mean()) / ref.std()
    rows = localize.dtw_search(q, dist, z, stride=4).select("start", "pred", F.lit("warp").alias("method"))
    rows = rows.unionByName(localize.place_windows(q, dist, z, jump=3).select("start", "pred", F.lit("steps").alias("method"))).withColumn("e", F.abs(F.col("pred") - F.col("start")))
    return rows.groupBy("method").agg(F.count("*").alias("windows"), det_round(stats.median("e"), 4).alias("median_abs"), det_round(stats.share(F.col("e") <= 2), 4).alias("hits"))


@query()
def e36_selected_paths(spark, sf):
    """The full paths of each pass's candidate of the greatest score per sample."""
    dist, ref, scale = _map(spark, sf)
    paths = localize.track(_passes(spark, sf, scale), dist, ref / scale, sweeps.endpoint(0.0), best=True)
    return paths.select("pass", "config", "idx", "pred", "truth")


@query()
def e20_left_out_warps(spark, sf):
    """Each pass against the map of all others: as it lies, warped freely, and warped in a band."""
    own = matching.without_own(grid(spark, sf))
    rows = matching.pass_arrays(grid(spark, sf), ["pass"]).join(own, "pass")
    return rounded(localize.warp_table(rows, 6.0), ["pass", "n"], "identity", "free", "banded", "scale", "offset", digits=4)


@query()
def e24_e25_alignment_evaluation(spark, sf):
    """Passes against the raw, the aligned and the selectively aligned map of all passes."""
    g = grid(spark, sf).select("pass", "cell", "v")
    made = {"raw": maps.stack(g, "median"), "aligned": localize.aligned_reference(g), "selective": localize.aligned_reference(g, accept=(0.5, 5.0))}
    laid = None  # three maps of one track, each checked for size
    for name, ref in made.items():
        got = ref.select("cell", F.col("v").alias("rv"), F.lit(name).alias("reference"))
        laid = got if laid is None else laid.unionByName(got)
    out = g.join(F.broadcast(laid), "cell").groupBy("reference", "pass").agg(F.count("*").alias("n"), F.corr("v", "rv").alias("corr"), stats.rmse(F.col("v") - F.col("rv")).alias("rms"))
    return rounded(out, ["reference", "pass", "n"], "corr", "rms", digits=4)


@query()
def e37_offset_cases(spark, sf):
    """Coarse search by squared difference and refinement by closest points, for several ranges."""
    dist, ref, _ = _map(spark, sf)
    cases = {"near": (4, 4.0), "wide": (10, 8.0), "far": (16, 8.0)}
    return localize.refine_offsets(grid(spark, sf), dist, ref, cases).select("case", "pass", det_round("offset", 2).alias("offset"))


# ---- graph SLAM
NODE = 12


def _nodes(spark, sf):
    rows = matching.pass_arrays(grid(spark, sf), ["pass"]).withColumn("direction", F.when(F.col("pass") % 2 == 0, 1).otherwise(-1))
    return slam.build_nodes(rows, 6, NODE)


@query(f"""WITH {SERIES}, {GRID}, av AS (SELECT pass, CASE WHEN pass % 2 = 0 THEN list(v ORDER BY cell) ELSE list(v ORDER BY cell DESC) END AS q, CASE WHEN pass % 2 = 0 THEN list(cell ORDER BY cell) ELSE list(cell ORDER BY cell DESC) END AS c FROM m GROUP BY pass),
  sm AS (SELECT pass, c, list_transform(range(1, len(q) + 1), lambda i: list_median(list_slice(q, greatest(i - 1, 1), i + 1))) AS q FROM av), nd AS (SELECT pass, c, q, k, k * 6 + {NODE} AS e FROM sm, (SELECT unnest(range(0, 20)) AS k) WHERE k * 6 + {NODE} <= len(q)),
  sg AS (SELECT pass, k, c[e] AS s, list_slice(q, e - {NODE - 1}, e) AS w FROM nd), g AS (SELECT *, list_transform(range(2, {NODE + 1}), lambda i: w[i] - w[i - 1]) AS d FROM sg)
  SELECT pass, k, s, {r('(w[1] - list_avg(w)) / list_stddev_pop(w)', 5)} AS head, {r('(d[1] - list_avg(d)) / list_stddev_pop(d)', 5)} AS step FROM g""")
def g1_g2_nodes(spark, sf):
    return _nodes(spark, sf).select("pass", "k", "s", det_round(F.get("sig", F.lit(0)), 5).alias("head"), det_round(F.get("grad", F.lit(0)), 5).alias("step"))


@query()
def g3_g7_slam_runs(spark, sf):
    """Every track of five passes under the five configurations."""
    nodes = _nodes(spark, sf).withColumn("track", F.floor(F.col("pass") / 5).cast("long"))
    return rounded(slam.run_tracks(nodes, "track", slam.RUNS), ["track", "config", "nodes", "loops", "false_loops"], "odometry_rmse", "rmse", digits=4)


# ---- reliability
@query(f"""WITH {SERIES}, {GRID}, {RFM}, p AS (SELECT pass, idx, g, (idx * 7) % 48 AS pred FROM s), l AS (SELECT pass, idx, g, pred, cell, -2 * ln(1 + ((g - rv) / 30) ** 2 / 3) AS ll FROM p, rf),
  b AS (SELECT pass, idx, any_value(g) AS g, any_value(pred) AS pred, arg_min(cell, (-floor(ll * 1e9 + 0.5), cell)) AS best, max(ll) AS top, max(ll) FILTER (WHERE cell = pred) AS lp FROM l GROUP BY ALL),
  f AS (SELECT b.pass, b.idx, any_value(lp) - any_value(top) AS lp, abs(any_value(b.pred) - any_value(best)) AS gap, any_value(top) - max(ll) FILTER (WHERE abs(cell - best) > 5) AS margin FROM b LEFT JOIN l ON l.pass = b.pass AND l.idx = b.idx AND b.g IS NOT NULL GROUP BY ALL),
  k AS (SELECT pass, idx, lp, CASE WHEN lp IS NOT NULL THEN gap END AS gap, margin FROM f) SELECT pass, idx, {r('coalesce(lp, (SELECT median(lp) FROM k))', 5)} AS ll_at_pred, {r('coalesce(gap, (SELECT median(gap) FROM k))', 5)} AS to_best, {r('coalesce(margin, (SELECT median(margin) FROM k))', 5)} AS margin FROM k""")
def l2_confidence_features(spark, sf):
    """Likelihood at the prediction, its distance from the likeliest place, and that place's margin; gaps take the median."""
    ref = matching.one_row(_reference(spark, sf), "_ref", "cell", "v")
    rows = matching.beside(series(spark, sf).select("pass", "idx", "g", ((F.col("idx") * 7) % 48).alias("pred")), ref)
    ll = F.transform("_ref", lambda t: F.struct(t["cell"].alias("s"), log_likelihood("g", t["v"], 30.0, True).alias("score")))
    rows = rows.withColumn("_l", F.when(F.col("g").isNotNull(), ll)).withColumn("_b", matching.top_entry("_l"))
    at = F.get(F.filter("_l", lambda t: t["s"] == F.col("pred")), F.lit(0))["score"] - F.col("_b.score")
    rival = F.array_max(F.transform(F.filter("_l", lambda t: F.abs(t["s"] + F.col("_b.m")) > 5), lambda t: t["score"]))
    rows = rows.select("pass", "idx", at.alias("ll_at_pred"), F.abs(F.col("pred") + F.col("_b.m")).cast("double").alias("to_best"), (F.col("_b.score") - rival).alias("margin"))
    names = ["ll_at_pred", "to_best", "margin"]
    middle = rows.agg(*[stats.median(n).alias(f"_{n}") for n in names])
    return matching.beside(rows, middle).select("pass", "idx", *[det_round(F.coalesce(n, F.col(f"_{n}")), 5).alias(n) for n in names])
