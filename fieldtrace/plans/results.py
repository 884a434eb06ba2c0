"""Queries of the aggregation, ordering, set, selection and evaluation operators.

Orders play the table of results (segment, method, tag, signed error, margin); events the passes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import det_round, number_after, short_label
from ..operators import evaluate, maps, quantiles
from .registry import GRID, SERIES, grid, query, r, series, table

RES = """res AS (SELECT o_orderkey AS id, 'seg' || (o_custkey % 40)::VARCHAR AS segment, o_orderpriority AS method, o_orderstatus AS tag, o_orderdate AS time,
  (o_totalprice % 1000) / 10 - 40 AS err, (o_totalprice % 70) / 7 AS margin FROM orders)"""


def res(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("seg"), (F.col("o_custkey") % 40).cast("string")).alias("segment"), F.col("o_orderpriority").alias("method"),
        F.col("o_orderstatus").alias("tag"), F.col("o_orderdate").alias("time"), ((F.col("o_totalprice") % 1000) / 10 - 40).alias("err"), ((F.col("o_totalprice") % 70) / 7).alias("margin"),
    )


def rounded(df, keys, *cols, digits=5):
    return df.select(*keys, *[det_round(x, digits).alias(x) for x in cols])


@query(f"""SELECT l_suppkey AS segment, min(l_extendedprice) AS s_min, max(l_extendedprice) AS s_max, count(*) AS samples, {r('avg(l_quantity)')} AS mean_q,
  array_to_string(list_sort(list(DISTINCT l_returnflag)), '; ') AS files FROM lineitem GROUP BY l_suppkey""")
def a1_coverage_table(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("segment")).agg(
        F.min("l_extendedprice").alias("s_min"), F.max("l_extendedprice").alias("s_max"), F.count("*").alias("samples"), det_round(F.avg("l_quantity")).alias("mean_q"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("files"),
    )


@query(f"""WITH {SERIES} SELECT pass, floor(t / 7200)::BIGINT AS pos, arg_min(event_id, idx) AS first_id, {r('avg(v)')} AS mean_v, {r('median(v)')} AS med_v FROM s GROUP BY ALL""")
def a2_collapse_positions(spark, sf):
    return series(spark, sf).groupBy("pass", F.floor(F.col("t") / 7200).alias("pos")).agg(
        F.min_by("event_id", "idx").alias("first_id"), det_round(F.avg("v")).alias("mean_v"), det_round(stats.median("v")).alias("med_v")
    )


FUSED = f"""{GRID}, q AS (SELECT *, median(v) OVER (PARTITION BY cell) AS md FROM m),
  f AS (SELECT cell, count(*) AS n, any_value(md) AS median, avg(v) AS mean, stddev_samp(v) AS std, median(abs(v - md)) AS mad FROM q GROUP BY cell)"""


@query(f"""WITH {SERIES}, {FUSED} SELECT cell, n, {r('median')} AS median, {r('mean')} AS mean, {r('std')} AS std, {r('mad')} AS mad,
  {r("CASE WHEN count(median) OVER w >= 3 THEN quantile_cont(median, 0.5) OVER w END")} AS smooth FROM f WINDOW w AS (ORDER BY cell ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def a3_fused_map(spark, sf):
    return rounded(maps.fused_map(grid(spark, sf)), ["cell", "n"], "median", "mean", "std", "mad", "smooth", digits=6)


@query(f"WITH {RES}, m AS (SELECT *, median(err) OVER (PARTITION BY method) AS md FROM res) SELECT method, {r('any_value(md)')} AS med, {r('median(abs(err - md))')} AS mad FROM m GROUP BY method")
def a4_mad(spark, sf):
    return stats.with_mad(res(spark, sf), ["method"], "err").groupBy("method").agg(det_round(F.first("med")).alias("med"), det_round(F.first("mad")).alias("mad"))


@query(f"""WITH {SERIES}, c AS (SELECT pass, idx % 48 AS cell, event_type AS channel, avg(v) AS v FROM s GROUP BY ALL)
  SELECT cell, channel, count(v) AS passes, {r('avg(v)', 9)} AS mean_v, {r('stddev_samp(v)')} AS std_v FROM c GROUP BY ALL""")
def a5_wide_map_statistics(spark, sf):
    rows = series(spark, sf).groupBy("pass", (F.col("idx") % 48).alias("cell"), F.col("event_type").alias("channel")).agg(F.avg("v").alias("v"))
    return rows.groupBy("cell", "channel").agg(F.count("v").alias("passes"), det_round(F.avg("v"), 9).alias("mean_v"), det_round(F.stddev_samp("v")).alias("std_v"))


@query(f"""WITH {SERIES}, b AS (SELECT pass, round_even(v * 2 / 20, 0)::BIGINT AS cell, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT DISTINCT pass, unnest(range(0, 31)) AS cell FROM s)
  SELECT g.pass, g.cell, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (pass, cell)""")
def a6_bin_counts(spark, sf):
    return maps.bin_counts(series(spark, sf).withColumn("x", F.col("v") / 20), ["pass"], "x", 2, 0, 30)


@query(f"""SELECT l_suppkey AS segment, floor(l_extendedprice / 10000)::BIGINT AS bin, count(*) AS n, {r('avg(l_quantity)')} AS mean_q, {r('median(l_quantity)')} AS med_q FROM lineitem GROUP BY ALL""")
def a7_binned_mean(spark, sf):
    """Spark's partial and final average; the exact median in place of an average of chunk medians."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("segment"), F.floor(F.col("l_extendedprice") / 10000).alias("bin")).agg(
        F.count("*").alias("n"), det_round(F.avg("l_quantity")).alias("mean_q"), det_round(stats.median("l_quantity")).alias("med_q")
    )


@query(f"WITH {SERIES} SELECT pass, idx, {r('v - median(v) OVER (PARTITION BY pass)')} AS anomaly FROM s")
def a8_group_median_anomaly(spark, sf):
    return series(spark, sf).select("pass", "idx", det_round(F.col("v") - stats.median("v").over(Window.partitionBy("pass"))).alias("anomaly"))


@query(f"WITH {SERIES} SELECT idx % 48 AS cell, count(DISTINCT pass) AS passes, count(DISTINCT event_type) AS kinds FROM s GROUP BY ALL")
def a9_distinct_count(spark, sf):
    return series(spark, sf).groupBy((F.col("idx") % 48).alias("cell")).agg(F.countDistinct("pass").alias("passes"), F.countDistinct("event_type").alias("kinds"))


WM = """c AS (SELECT cell, v, sum(n) OVER (PARTITION BY cell ORDER BY v) AS run, sum(n) OVER (PARTITION BY cell) AS tot FROM m)"""


@query(f"WITH {SERIES}, {GRID}, {WM} SELECT cell, {r('min(v)')} AS wm FROM c WHERE run >= 0.5 * tot GROUP BY cell")
def a10_weighted_median(spark, sf):
    return quantiles.weighted_median(grid(spark, sf), ["cell"], "v", "n", "wm").select("cell", det_round("wm").alias("wm"))


@query("""WITH k AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS track, value, 1 + event_id % 3 AS n FROM events),
  c AS (SELECT track, value, sum(n) OVER (PARTITION BY track ORDER BY value) AS run, sum(n) OVER (PARTITION BY track) AS tot FROM k) SELECT track, min(value) AS wm FROM c WHERE run >= 0.5 * tot GROUP BY track""")
def a10_weighted_median_hot(spark, sf):
    """Weighted medians of raw rows, half of which belong to one key."""
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(F.when(i % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("track"), "value", (1 + i % 3).alias("n"))
    return quantiles.weighted_median(rows, ["track"], "value", "n", "wm")


SMOOTH = "CASE WHEN count(x) OVER w >= 1 THEN quantile_cont(x, 0.5) OVER w END"
W11 = "WINDOW w AS (ORDER BY cell ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


@query(f"WITH {SERIES}, {GRID}, f AS (SELECT cell, median(v) AS x FROM m GROUP BY cell) SELECT cell, {r(SMOOTH)} AS ref FROM f {W11}")
def a11_median_reference(spark, sf):
    return maps.reference(grid(spark, sf)).select("cell", det_round("v").alias("ref"))


@query(f"WITH {SERIES}, {GRID}, {WM}, f AS (SELECT cell, min(v) AS x FROM c WHERE run >= 0.5 * tot GROUP BY cell) SELECT cell, {r(SMOOTH)} AS ref FROM f {W11}")
def a12_weighted_reference(spark, sf):
    return maps.reference(grid(spark, sf), weight="n").select("cell", det_round("v").alias("ref"))


@query(f"WITH {SERIES}, {GRID} SELECT cell, {r('avg(v)')} AS mean_v, {r('median(v)')} AS median_v FROM m GROUP BY cell")
def a13_a14_stacks(spark, sf):
    g = grid(spark, sf)
    return maps.stack(g, "mean").withColumnRenamed("v", "a").join(maps.stack(g, "median"), "cell").select("cell", det_round("a").alias("mean_v"), det_round("v").alias("median_v"))


@query(f"WITH {SERIES}, {GRID}, d AS (SELECT cell, stddev_pop(v) AS sd FROM m GROUP BY cell) SELECT {r('quantile_cont(sd, 0.5)')} AS p50, {r('quantile_cont(sd, 0.75)')} AS p75, {r('quantile_cont(sd, 0.9)')} AS p90 FROM d")
def a15_map_spread(spark, sf):
    return rounded(maps.spread(grid(spark, sf), value="v"), [], "p50", "p75", "p90", digits=6)


PER = f"""{RES}, per AS (SELECT segment, method, tag, median(abs(err)) AS med, sqrt(avg(err * err)) AS rmse, arg_max(abs(err), id) AS fin FROM res GROUP BY ALL)"""


def per_segment(spark, sf):
    e = F.abs("err")
    return res(spark, sf).groupBy("segment", "method", "tag").agg(stats.median(e).alias("med"), stats.rmse("err").alias("rmse"), F.max_by(e, "id").alias("fin"))


@query(f"WITH {PER} SELECT method, count(*) AS segments, {r('median(med)', 5)} AS med, {r('avg(med)', 5)} AS mean_med, {r('avg(rmse)', 5)} AS rmse, {r('max(fin)', 5)} AS worst FROM per GROUP BY method ORDER BY med, mean_med, rmse")
def a16_method_summary(spark, sf):
    """The summary's rmse is the mean of the segments' rmse."""
    out = per_segment(spark, sf).groupBy("method").agg(F.count("*").alias("segments"), stats.median("med").alias("m"), F.avg("med").alias("mean_med"), F.avg("rmse").alias("rmse"), F.max("fin").alias("worst"))
    return rounded(out.withColumnRenamed("m", "med"), ["method", "segments"], "med", "mean_med", "rmse", "worst").orderBy("med", "mean_med", "rmse")


@query(f"WITH {PER} SELECT tag, method, count(*) AS segments, {r('median(med)', 5)} AS med, {r('avg(rmse)', 5)} AS rmse FROM per GROUP BY ALL")
def a17_two_key_summary(spark, sf):
    out = per_segment(spark, sf).groupBy("tag", "method").agg(F.count("*").alias("segments"), stats.median("med").alias("med"), F.avg("rmse").alias("rmse"))
    return rounded(out, ["tag", "method", "segments"], "med", "rmse")


@query(f"""WITH {RES}, b AS (SELECT *, median(err) OVER (PARTITION BY method) AS bias FROM res) SELECT method, {r('any_value(bias)', 5)} AS bias, {r('median(abs(err - bias))', 5)} AS c50,
  {r('quantile_cont(abs(err - bias), 0.75)', 5)} AS c75, {r('median(abs(err))', 5)} AS p50, {r('quantile_cont(abs(err), 0.75)', 5)} AS p75, {r('quantile_cont(abs(err), 0.9)', 5)} AS p90 FROM b GROUP BY method""")
def a18_bias_corrected(spark, sf):
    rows = res(spark, sf).withColumn("bias", stats.median("err").over(Window.partitionBy("method")))
    cor, raw = F.abs(F.col("err") - F.col("bias")), F.abs("err")
    out = rows.groupBy("method").agg(F.first("bias").alias("bias"), stats.median(cor).alias("c50"), F.percentile(cor, F.lit(0.75)).alias("c75"), stats.median(raw).alias("p50"), F.percentile(raw, F.lit(0.75)).alias("p75"), F.percentile(raw, F.lit(0.9)).alias("p90"))
    return rounded(out, ["method"], "bias", "c50", "c75", "p50", "p75", "p90")


@query(f"""WITH {RES} SELECT method, tag, id % 2 AS a, id % 3 AS b, id % 5 AS c, count(*) AS n, {r('median(abs(err))', 5)} AS med, {r('median(abs(err)) FILTER (WHERE err > 0)', 5)} AS fwd, {r('median(abs(err)) FILTER (WHERE err <= 0)', 5)} AS bwd FROM res GROUP BY ALL""")
def a19_five_key_summary(spark, sf):
    e = F.abs("err")
    out = res(spark, sf).groupBy("method", "tag", (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 5).alias("c")).agg(
        F.count("*").alias("n"), stats.median(e).alias("med"), stats.median(F.when(F.col("err") > 0, e)).alias("fwd"), stats.median(F.when(F.col("err") <= 0, e)).alias("bwd")
    )
    return rounded(out, ["method", "tag", "a", "b", "c", "n"], "med", "fwd", "bwd")


@query(f"WITH {RES} SELECT method, {r('sqrt(avg(err * err))', 5)} AS rmse, {r('quantile_cont(abs(err), 0.9)', 5)} AS p90, count(*) FILTER (WHERE margin >= 5) AS accepted, {r('max(abs(err))', 5)} AS worst FROM res GROUP BY method")
def a20_rmse_p90(spark, sf):
    out = res(spark, sf).groupBy("method").agg(stats.rmse("err").alias("rmse"), F.percentile(F.abs("err"), F.lit(0.9)).alias("p90"), F.count_if(F.col("margin") >= 5).alias("accepted"), stats.max_abs("err").alias("worst"))
    return rounded(out, ["method", "accepted"], "rmse", "p90", "worst")


METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH {RES}, p AS (SELECT segment, {', '.join(f'arg_min(err, id) FILTER (WHERE method = {m!r}) AS m{i}' for i, m in enumerate(METHODS))} FROM res GROUP BY segment)
  SELECT segment, {', '.join(f'{r(f"m{i}", 4)} AS m{i}' for i in range(5))} FROM p WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL AND m4 IS NOT NULL""")
def a22_pivot(spark, sf):
    wide = res(spark, sf).groupBy("segment").pivot("method", METHODS).agg(F.min_by("err", "id"))
    return wide.na.drop().select("segment", *[det_round(F.col(f"`{m}`"), 4).alias(f"m{i}") for i, m in enumerate(METHODS)])


@query(f"""WITH {RES}, x AS (SELECT 'all' AS subset, * FROM res UNION ALL SELECT 'confident', * FROM res WHERE margin >= 5 UNION ALL SELECT 'late', * FROM res WHERE id % 4 = 0)
  SELECT subset, method, count(*) AS n, {r('median(abs(err))', 5)} AS med, {r('sqrt(avg(err * err))', 5)} AS rmse FROM x GROUP BY ALL""")
def a23_subset_summary(spark, sf):
    rows = evaluate.explode_membership(res(spark, sf), {"all": F.lit(True), "confident": F.col("margin") >= 5, "late": F.col("id") % 4 == 0})
    return rounded(rows.groupBy("subset", "method").agg(F.count("*").alias("n"), stats.median(F.abs("err")).alias("med"), stats.rmse("err").alias("rmse")), ["subset", "method", "n"], "med", "rmse")


RANK = f"""{RES}, rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY margin DESC, id DESC) AS rk FROM res)"""


@query(f"""WITH {RANK}, f AS (SELECT segment, min(rk) FILTER (WHERE abs(err) <= 5) AS r5, min(rk) FILTER (WHERE abs(err) <= 10) AS r10, min(rk) FILTER (WHERE abs(err) <= 25) AS r25 FROM rk GROUP BY segment)
  SELECT segment, r5 AS rank_5, r10 AS rank_10, r25 AS rank_25, {', '.join(f'coalesce(r{t} <= {k}, false)::INT AS top{k}_{t}' for t in (5, 10, 25) for k in (1, 3, 5))} FROM f""")
def t2_topk_hits(spark, sf):
    rows = res(spark, sf).withColumn("truth", F.col("id") - F.col("err"))
    return evaluate.topk_hits(rows, "segment", "margin", "id", "truth", [5, 10, 25], [1, 3, 5])


@query(f"""WITH {RANK}, f AS (SELECT segment, min(rk) FILTER (WHERE abs(err) <= 10) AS r10 FROM rk GROUP BY segment)
  SELECT count(*) AS n, {', '.join(f'{r(f"avg(coalesce(r10 <= {k}, false)::INT)")} AS top{k}_10' for k in (1, 3, 5))} FROM f""")
def a24_hit_rates(spark, sf):
    hits = t2_topk_hits(spark, sf)
    return hits.agg(F.count("*").alias("n"), *[det_round(F.avg(f"top{k}_10")).alias(f"top{k}_10") for k in (1, 3, 5)])


@query(f"WITH {PER} SELECT tag, method, count(*) AS n, {', '.join(f'{r(f"median({x})", 5)} AS med_{x}, {r(f"avg({x})", 5)} AS mean_{x}' for x in ('med', 'rmse', 'fin'))} FROM per GROUP BY ALL")
def a21_a25_a26_summaries(spark, sf):
    """Medians and means of several metrics by candidate and tag."""
    out = per_segment(spark, sf).groupBy("tag", "method").agg(F.count("*").alias("n"), *[f(x).alias(f"{k}_{x}") for x in ("med", "rmse", "fin") for k, f in (("med", stats.median), ("mean", F.avg))])
    return rounded(out, ["tag", "method", "n"], *[f"{k}_{x}" for x in ("med", "rmse", "fin") for k in ("med", "mean")])


@query(f"""WITH {SERIES}, {GRID}, b AS (SELECT pass, max(v) AS best, arg_min(cell, (-v, cell)) AS position FROM m GROUP BY pass)
  SELECT b.pass, {r('best')} AS best, position, {r('(SELECT max(v) FROM m WHERE m.pass = b.pass AND abs(m.cell - b.position) >= 10)')} AS second FROM b""")
def t1_argmax_runner_up(spark, sf):
    out = evaluate.argmax_with_runner_up(grid(spark, sf), "pass", "v", "cell", 10)
    return out.select("pass", det_round("best").alias("best"), "position", det_round("second").alias("second"))


@query(f"""WITH RECURSIVE {SERIES}, {GRID}, k AS (SELECT pass, cell::DOUBLE AS p, v AS sc, row_number() OVER (PARTITION BY pass ORDER BY v DESC, cell) AS o FROM m), w(pass, o, kept) AS (SELECT pass, 0::BIGINT, []::DOUBLE[] FROM m GROUP BY pass UNION ALL
  SELECT w.pass, k.o, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda y: abs(y - k.p) < 5)) = 0 THEN list_append(kept, k.p) ELSE kept END FROM w JOIN k ON k.pass = w.pass AND k.o = w.o + 1),
  e AS (SELECT pass, arg_max(kept, o) AS kept FROM w GROUP BY pass), u AS (SELECT pass, unnest(kept) AS position, generate_subscripts(kept, 1) AS rank FROM e)
  SELECT u.pass, u.rank::BIGINT AS rank, u.position, k.sc AS score FROM u JOIN k ON k.pass = u.pass AND k.p = u.position""")
def t3_separated_top(spark, sf):
    return evaluate.separated_top(grid(spark, sf), "pass", "v", "cell", 8, 5)


@query(f"""WITH {RES}, k AS (SELECT segment, method, id, err, row_number() OVER (PARTITION BY segment, method ORDER BY margin DESC, id) AS rk FROM res WHERE method IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
  SELECT segment, method, id, err FROM k WHERE rk = 1 UNION ALL SELECT segment, method, id, err FROM res WHERE method NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def t4_best_row(spark, sf):
    rows, some = res(spark, sf), F.col("method").isin(METHODS[:3])
    best = rows.where(some).withColumn("rk", F.row_number().over(Window.partitionBy("segment", "method").orderBy(F.col("margin").desc(), "id"))).where("rk = 1")
    return best.select("segment", "method", "id", "err").unionByName(rows.where(~some).select("segment", "method", "id", "err"))


@query(f"WITH {RES} SELECT segment, arg_max(id, (margin, -id)) AS chosen, arg_min(id, (abs(err), id)) AS oracle_best, count(*) FILTER (WHERE margin >= 5) AS above FROM res GROUP BY segment")
def t5_idxmax(spark, sf):
    return res(spark, sf).groupBy("segment").agg(
        F.max_by("id", F.struct(F.col("margin"), -F.col("id"))).alias("chosen"), F.min_by("id", F.struct(F.abs("err"), F.col("id"))).alias("oracle_best"), F.count_if(F.col("margin") >= 5).alias("above")
    )


THRESHOLDS = [0, 0.5, 1, 2, 3, 4, 5, 7, 9]
SWEEP = f"""{RES}, g AS (SELECT unnest([{', '.join(f'{float(t)}' for t in THRESHOLDS)}])::DOUBLE AS threshold), n AS (SELECT method, count(*) AS total FROM res GROUP BY method)"""


@query(f"""WITH {SWEEP} SELECT method, threshold, count(*) FILTER (WHERE margin >= threshold) AS accepted, {r('count(*) FILTER (WHERE margin >= threshold) / any_value(total)')} AS coverage,
  {r('median(abs(err)) FILTER (WHERE margin >= threshold)', 5)} AS median_abs, {r('quantile_cont(abs(err), 0.9) FILTER (WHERE margin >= threshold)', 5)} AS p90,
  {r('sqrt(avg(err * err) FILTER (WHERE margin >= threshold))', 5)} AS rmse FROM res JOIN n USING (method), g GROUP BY ALL""")
def e5_e6_gate_sweep(spark, sf):
    out = evaluate.gate_sweep(res(spark, sf), ["method"], "margin", "err", THRESHOLDS)
    return out.select("method", "threshold", "accepted", det_round("coverage").alias("coverage"), *[det_round(x, 5).alias(x) for x in ("median_abs", "p90", "rmse")])


@query(f"WITH {SWEEP} SELECT threshold, {r('count(*) FILTER (WHERE margin >= threshold) / count(*)')} AS coverage, {r('median(abs(err)) FILTER (WHERE margin >= threshold)', 5)} AS median_abs FROM res, g GROUP BY threshold ORDER BY coverage DESC, median_abs")
def t6_rejection_order(spark, sf):
    out = evaluate.gate_sweep(res(spark, sf), [], "margin", "err", THRESHOLDS)
    return out.select("threshold", det_round("coverage").alias("coverage"), det_round("median_abs", 5).alias("median_abs")).orderBy(F.desc("coverage"), "median_abs")


@query(f"""WITH {RES}, g AS (SELECT method, median(abs(err)) AS m, quantile_cont(abs(err), 0.75) AS q, avg((margin >= 8)::INT) AS rate FROM res GROUP BY method)
  SELECT method, {r('m + 0.5 * q + 20 * greatest(0, 0.30 - rate)', 5)} AS rank_score FROM g ORDER BY rank_score""")
def t7_composite_rank(spark, sf):
    e = F.abs("err")
    g = res(spark, sf).groupBy("method").agg(stats.median(e).alias("m"), F.percentile(e, F.lit(0.75)).alias("q"), stats.share(F.col("margin") >= 8).alias("rate"))
    score = F.col("m") + 0.5 * F.col("q") + 20 * F.greatest(F.lit(0.0), 0.30 - F.col("rate"))
    return g.select("method", det_round(score, 5).alias("rank_score")).orderBy("rank_score")


@query(f"""WITH {RES} SELECT method, segment, err, NULL::DOUBLE AS margin FROM res WHERE tag = 'O' UNION ALL SELECT replace(method, '-', '_'), segment, NULL, margin FROM res WHERE tag = 'F'""")
def u1_union_tolerant(spark, sf):
    rows = res(spark, sf)
    right = rows.where("tag = 'F'").select(F.replace("method", F.lit("-"), F.lit("_")).alias("method"), "segment", "margin")
    return rows.where("tag = 'O'").select("method", "segment", "err").unionByName(right, allowMissingColumns=True)


@query(f"WITH {RES} SELECT segment, min(id) AS first_id FROM res GROUP BY segment ORDER BY first_id")
def u2_ordered_distinct(spark, sf):
    return res(spark, sf).groupBy("segment").agg(F.min("id").alias("first_id")).orderBy("first_id")


@query(f"WITH {SERIES}, {GRID}, a AS (SELECT DISTINCT cell FROM m WHERE pass % 2 = 0), b AS (SELECT DISTINCT cell FROM m WHERE pass % 2 = 1) SELECT cell FROM a INTERSECT SELECT cell FROM b")
def u3_intersect(spark, sf):
    g = grid(spark, sf)
    return g.where("pass % 2 = 0").select("cell").intersect(g.where("pass % 2 = 1").select("cell"))


@query(f"SELECT o_orderkey AS id, regexp_extract('x_vmax' || (o_orderkey % 17 / 10.0)::DECIMAL(9,1)::VARCHAR || '_t', 'vmax([0-9.]+)', 1)::DOUBLE AS vmax, replace('BMAW_seg' || (o_custkey % 40)::VARCHAR, 'BMAW_', '') AS label FROM orders")
def x1_x2_labels(spark, sf):
    name = F.concat(F.lit("x_vmax"), ((F.col("o_orderkey") % 17) / 10).cast("decimal(9,1)").cast("string"), F.lit("_t"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), number_after(name, "vmax").alias("vmax"), short_label(F.concat(F.lit("BMAW_seg"), (F.col("o_custkey") % 40).cast("string")), "BMAW_").alias("label"))


# ---- trajectories: a pass's value is the prediction, a smooth function of its index the truth
TRAJ = f"{SERIES}, tr AS (SELECT pass, idx, v AS pred, 5.0 * idx + 10 AS truth, v - (5.0 * idx + 10) AS err FROM s)"


def traj(spark, sf):
    truth = F.col("idx") * 5.0 + 10
    return series(spark, sf).select("pass", "idx", F.col("v").alias("pred"), truth.alias("truth"), (F.col("v") - truth).alias("err"))


METRICS = ["mean_error", "median_abs", "mean_abs", "rmse", "p75", "p90", "final_abs"]
METRIC_SQL = f"""count(*) AS sample_count, {r('avg(err)', 5)} AS mean_error, {r('median(abs(err))', 5)} AS median_abs, {r('avg(abs(err))', 5)} AS mean_abs, {r('sqrt(avg(err * err))', 5)} AS rmse,
  {r('quantile_cont(abs(err), 0.75)', 5)} AS p75, {r('quantile_cont(abs(err), 0.9)', 5)} AS p90, {r('arg_max(abs(err), idx)', 5)} AS final_abs"""


@query(f"WITH {TRAJ}, n AS (SELECT pass, least(20, floor(count(*) / 10)) AS warm FROM tr GROUP BY pass) SELECT pass, {METRIC_SQL} FROM tr JOIN n USING (pass) WHERE idx >= warm GROUP BY pass")
def e1_trajectory_metrics(spark, sf):
    rows = traj(spark, sf)
    warm = rows.groupBy("pass").agg(F.least(F.lit(20), F.floor(F.count("*") / 10)).alias("warm"))
    out = rows.join(warm, "pass").where("idx >= warm").groupBy("pass").agg(*evaluate.error_metrics("err"))
    return rounded(out, ["pass", "sample_count"], *METRICS)


@query(f"""WITH {TRAJ}, n AS (SELECT pass, count(*) AS total FROM tr GROUP BY pass) SELECT pass, {METRIC_SQL}, {r('count(*) / any_value(total)')} AS coverage, {r('avg((abs(err) <= 25)::INT)')} AS within_25, {r('avg((abs(err) <= 50)::INT)')} AS within_50
  FROM tr JOIN n USING (pass) WHERE idx < 40 GROUP BY pass""")
def e2_metrics_trimmed(spark, sf):
    rows = traj(spark, sf).withColumn("total", F.count("*").over(Window.partitionBy("pass"))).where("idx < 40")
    out = rows.groupBy("pass").agg(*evaluate.error_metrics("err", total=F.first("total")), *evaluate.within("err", 25, 50))
    return rounded(out, ["pass", "sample_count"], *METRICS).join(out.select("pass", *[det_round(x).alias(x) for x in ("coverage", "within_25", "within_50")]), "pass")


@query(f"""WITH {TRAJ} SELECT pass, {r('arg_min(abs(err), idx)', 5)} AS start_abs, {r('arg_max(abs(err), idx)', 5)} AS end_abs,
  {r('(arg_max(pred, idx) - arg_min(pred, idx)) - (arg_max(truth, idx) - arg_min(truth, idx))', 5)} AS net_error FROM tr GROUP BY pass""")
def e3_endpoint_metrics(spark, sf):
    a, net = F.abs("err"), lambda x: F.max_by(x, "idx") - F.min_by(x, "idx")
    return traj(spark, sf).groupBy("pass").agg(det_round(F.min_by(a, "idx"), 5).alias("start_abs"), det_round(F.max_by(a, "idx"), 5).alias("end_abs"), det_round(net("pred") - net("truth"), 5).alias("net_error"))


@query(f"""WITH {SERIES}, d AS (SELECT pass, arg_min(v, idx) AS p0, arg_max(v, idx) AS p1, max(idx) AS fin_i FROM s GROUP BY pass),
  e AS (SELECT s.pass, idx, fin_i, v * CASE WHEN p1 >= p0 THEN 1 ELSE -1 END AS x, p1 * CASE WHEN p1 >= p0 THEN 1 ELSE -1 END AS fin FROM s JOIN d USING (pass)),
  f AS (SELECT pass, max(x) AS top, arg_min(idx, (-x, idx)) AS peak, any_value(fin) AS fin, any_value(fin_i) AS fin_i FROM e GROUP BY pass)
  SELECT pass, CASE WHEN top - fin > 20 AND fin_i - peak >= 10 THEN peak ELSE fin_i END AS stop FROM f""")
def e4_trim_stop(spark, sf):
    return evaluate.trim_stop(series(spark, sf), "pass", "v", "idx", 20, 10)


QS = [0, 0.25, 0.5, 0.75]


@query(f"""WITH {RES}, q AS (SELECT method, quantile_cont(margin, [0, 0.25, 0.5, 0.75]) AS qs FROM res GROUP BY method), x AS (SELECT method, unnest(qs) AS threshold, unnest([0, 0.25, 0.5, 0.75])::DOUBLE AS q FROM q)
  SELECT x.method, x.q, {r('threshold')} AS threshold, count(*) AS accepted, {r('avg((abs(err) <= 5)::INT)')} AS good_5, {r('avg((abs(err) <= 10)::INT)')} AS good_10, {r('avg((abs(err) <= 20)::INT)')} AS good_20, {r('median(abs(err))', 5)} AS median_abs
  FROM x JOIN res ON res.method = x.method AND margin >= threshold GROUP BY ALL""")
def e7_e8_quantile_gates(spark, sf):
    """Thresholds at quantiles of each method's margins; accepted rows repeat once for each threshold that they pass."""
    rows = res(spark, sf)
    qs = rows.groupBy("method").agg(F.percentile("margin", F.array(*[F.lit(float(q)) for q in QS])).alias("qs"))
    out = rows.join(qs, "method").select("method", "err", "margin", F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in QS]).alias("q"), F.col("qs").alias("threshold"))).alias("g")).where(F.col("margin") >= F.col("g.threshold"))
    a = F.abs("err")
    return out.groupBy("method", F.col("g.q").alias("q"), det_round(F.col("g.threshold")).alias("threshold")).agg(
        F.count("*").alias("accepted"), *[det_round(stats.share(a <= k)).alias(f"good_{k}") for k in (5, 10, 20)], det_round(stats.median(a), 5).alias("median_abs")
    )


@query(f"""WITH {TRAJ}, f AS (SELECT pass, regr_slope(pred, truth) AS k, regr_intercept(pred, truth) AS b, regr_r2(pred, truth) AS r2, sqrt((regr_syy(pred, truth) - regr_sxy(pred, truth) * regr_sxy(pred, truth) / regr_sxx(pred, truth)) / count(*)) AS rm FROM tr GROUP BY pass)
  SELECT pass, {r('k')} AS scale, {r('b', 4)} AS offset_m, {r('rm', 4)} AS rmse FROM f""")
def e9_c19_affine_fit(spark, sf):
    fit = traj(spark, sf).groupBy("pass").agg(
        F.regr_slope("pred", "truth").alias("k"), F.regr_intercept("pred", "truth").alias("b"),
        F.sqrt((F.regr_syy("pred", "truth") - F.regr_sxy("pred", "truth") ** 2 / F.regr_sxx("pred", "truth")) / F.count("*")).alias("rm"),
    )
    return fit.select("pass", det_round("k").alias("scale"), det_round("b", 4).alias("offset_m"), det_round("rm", 4).alias("rmse"))


CAND = f"""{RES}, ca AS (SELECT segment, method, max(margin) AS margin, median(abs(err)) AS compat0, (min(id) % 9) / 10.0 + 0.8 AS vmax FROM res GROUP BY ALL), cb AS (SELECT segment, method, margin, compat0 / 10 AS compat, vmax FROM ca)"""


def candidates(spark, sf):
    rows = res(spark, sf).groupBy("segment", "method").agg(F.max("margin").alias("margin"), (stats.median(F.abs("err")) / 10).alias("compat"), ((F.min("id") % 9) / 10.0 + 0.8).alias("vmax"))
    return rows


CHOOSE = """b1 AS (SELECT *, min(compat) OVER (PARTITION BY segment) AS bc FROM cb WHERE method <> '5-LOW'), b2 AS (SELECT *, max(margin) OVER (PARTITION BY segment) AS bm FROM b1 WHERE compat <= bc + 0.04),
  b3 AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY vmax DESC, compat, method) AS rk FROM b2 WHERE margin >= bm - 0.2)"""


@query(f"WITH {CAND}, {CHOOSE} SELECT segment, method, {r('compat')} AS compat, {r('margin')} AS margin FROM b3 WHERE rk = 1")
def e12_candidate_choice(spark, sf):
    return rounded(evaluate.choose_total(candidates(spark, sf).where("method <> '5-LOW'"), "segment"), ["segment", "method"], "compat", "margin", digits=6)


@query(f"""WITH {CAND}, {CHOOSE} SELECT t.segment, t.method AS total_method, CASE WHEN coalesce(a.margin >= 5 AND a.compat + 0.04 < t.compat, false) THEN 'axis' ELSE 'total' END AS source,
  CASE WHEN coalesce(a.margin >= 5 AND a.compat + 0.04 < t.compat, false) THEN a.method ELSE t.method END AS selected FROM b3 t LEFT JOIN cb a ON a.segment = t.segment AND a.method = '5-LOW' WHERE rk = 1""")
def e13_progress_margin_selector(spark, sf):
    rows = candidates(spark, sf)
    return evaluate.select_progress_margin(rows.where("method <> '5-LOW'"), rows.where("method = '5-LOW'"), "segment").select("segment", "total_method", "source", "selected")


@query(f"WITH {TRAJ}, p AS (SELECT pass, abs(arg_max(pred, idx) - arg_min(pred, idx)) AS p, abs(arg_max(truth, idx) - arg_min(truth, idx)) AS i FROM tr GROUP BY pass) SELECT pass, {r('p')} AS progress, {r('abs(ln((p + 10) / (i + 10)))')} AS compat FROM p")
def e14_x5_progress_compat(spark, sf):
    rows = traj(spark, sf)
    both = evaluate.progress(rows, ["pass"], "pred", "idx").join(evaluate.progress(rows, ["pass"], "truth", "idx").withColumnRenamed("progress", "imu"), "pass")
    return evaluate.with_compat(both, "progress", "imu").select("pass", det_round("progress").alias("progress"), det_round("compat").alias("compat"))


@query(f"""WITH {CAND}, {CHOOSE} SELECT r.segment, r.id, r.method, date_diff('second', min(r.time) OVER (PARTITION BY r.segment), r.time) AS rel_s FROM res r JOIN (SELECT segment, method FROM b3 WHERE rk = 1) c USING (segment, method)""")
def e15_selected_rows(spark, sf):
    """Rows of the chosen candidate of each segment with seconds since the first of them."""
    chosen = evaluate.choose_total(candidates(spark, sf).where("method <> '5-LOW'"), "segment").select("segment", "method")
    rows = res(spark, sf).join(chosen, ["segment", "method"])
    sec = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 1000000)
    return rows.select("segment", "id", "method", (sec - F.min(sec).over(Window.partitionBy("segment"))).alias("rel_s"))


@query(f"WITH {SERIES}, m AS (SELECT pass, arg_min(idx, (v, idx)) AS low FROM s GROUP BY pass) SELECT pass, count(*) AS n, {r('median(v)')} AS med, {r('median(t)', 3)} AS med_t FROM s JOIN m USING (pass) WHERE idx >= low GROUP BY pass")
def e16_tail_quality(spark, sf):
    rows = series(spark, sf)
    at = rows.groupBy("pass").agg(F.min_by("idx", F.struct("v", "idx")).alias("at"))
    return rows.join(at, "pass").where("idx >= at").groupBy("pass").agg(F.count("*").alias("n"), det_round(stats.median("v")).alias("med"), det_round(stats.median("t"), 3).alias("med_t"))


@query(f"""WITH {RES}, d AS (SELECT segment, method, sum((err > 55)::INT) AS bad, count(*) AS n FROM res GROUP BY ALL), f AS (SELECT *, bad > 0.08 * n AS severe, bad > 0.04 * n AS warning FROM d),
  x AS (SELECT 'all' AS ev, * FROM f UNION ALL SELECT 'no_severe', * FROM f WHERE NOT severe UNION ALL SELECT 'clean', * FROM f WHERE NOT warning)
  SELECT ev, method, count(*) AS segments, sum(bad)::BIGINT AS bad, sum(n)::BIGINT AS n FROM x GROUP BY ALL""")
def e18_truth_flag_summary(spark, sf):
    d = res(spark, sf).groupBy("segment", "method").agg(F.count_if(F.col("err") > 55).alias("bad"), F.count("*").alias("n"))
    rows = evaluate.explode_membership(d, {"all": F.lit(True), "no_severe": F.col("bad") <= 0.08 * F.col("n"), "clean": F.col("bad") <= 0.04 * F.col("n")}, "ev")
    return rows.groupBy("ev", "method").agg(F.count("*").alias("segments"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))


@query(f"WITH {RES} SELECT method, count(*) AS n, {r('avg((abs(err) <= 25)::INT)')} AS good_rate_25, {r('median(abs(err))', 5)} AS med FROM res WHERE margin >= 9.9 GROUP BY method")
def e17_metric_row(spark, sf):
    out = res(spark, sf).where("margin >= 9.9").groupBy("method").agg(F.count("*").alias("n"), stats.share(F.abs("err") <= 25).alias("g"), stats.median(F.abs("err")).alias("med"))
    return out.select("method", "n", det_round("g").alias("good_rate_25"), det_round("med", 5).alias("med"))


@query(f"WITH {PER}, x AS (SELECT id % 2 AS experiment, * FROM res) SELECT experiment, method, count(*) AS n, {r('median(abs(err))', 5)} AS med, {r('avg(abs(err))', 5)} AS mean_abs FROM x GROUP BY ALL")
def e19_period_comparison(spark, sf):
    out = res(spark, sf).groupBy((F.col("id") % 2).alias("experiment"), "method").agg(F.count("*").alias("n"), stats.median(F.abs("err")).alias("med"), F.avg(F.abs("err")).alias("mean_abs"))
    return rounded(out, ["experiment", "method", "n"], "med", "mean_abs")
