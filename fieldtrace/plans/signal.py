"""Queries of the window, fill, resampling, interpolation and normalisation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, windows
from ..functions.scalars import det_round
from ..functions.windows import by_pass
from ..operators import resample
from ..operators import series as long_series
from .registry import GRID, SERIES, grid, query, r, series, table

P = "PARTITION BY pass ORDER BY idx"


def W():
    return by_pass("pass", "idx")


def _medians(rows, v: str, points: int, least: int):
    """Rolling medians of all passes, in blocks."""
    out = long_series.rolling_median(rows.select("pass", "idx", v), ["pass"], "idx", {"m": (v, points, least)})
    return out.select("pass", "idx", det_round("m").alias("m"))


def _high_pass(rows, v: str, points: int):
    out = long_series.rolling_median(rows.select("pass", "idx", v), ["pass"], "idx", {"m": (v, points, max(3, windows.odd_points(points) // 4))})
    return out.select("pass", "idx", det_round(F.col(v) - F.col("m")).alias("h"))


def _med(v: str, points: int, least: int) -> str:
    h = points // 2
    f = f"OVER ({P} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    return f"CASE WHEN count({v}) {f} >= {least} THEN quantile_cont({v}, 0.5) {f} END"


@query(f"WITH {SERIES} SELECT pass, idx, {r(_med('g', 9, 3))} AS m FROM s")
def w1_rolling_median(spark, sf):
    return _medians(series(spark, sf), "g", 9, 3)


@query(f"WITH {SERIES} SELECT pass, idx, {r(_med('g', 13, 4))} AS m FROM s")
def w2_rolling_median_third(spark, sf):
    return _medians(series(spark, sf), "g", 12, 4)


def _fill(v: str) -> str:
    back, ahead = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {v} IS NOT NULL THEN idx END"
    return f"""last_value({v} IGNORE NULLS) {back} AS v0, last_value({at} IGNORE NULLS) {back} AS r0,
      first_value({v} IGNORE NULLS) {ahead} AS v1, first_value({at} IGNORE NULLS) {ahead} AS r1"""


LERP = "CASE WHEN r1 = r0 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (idx - r0) / (r1 - r0), v0, v1) END"


@query(f"WITH {SERIES}, a AS (SELECT *, {_med('g', 5, 3)} AS md FROM s), b AS (SELECT *, {_fill('md')} FROM a) SELECT pass, idx, {r(LERP)} AS m FROM b")
def w3_rolling_median_filled(spark, sf):
    rows = long_series.rolling_median(series(spark, sf).select("pass", "idx", "g"), ["pass"], "idx", {"md": ("g", 5, 3)})
    return rows.select("pass", "idx", det_round(windows.linear_fill("md", "pass", "idx")).alias("m"))


@query(f"WITH {SERIES} SELECT pass, idx, {r(_med('v', 11, 3))} AS m FROM s")
def w4_rolling_median_span(spark, sf):
    """A span of 5 m at a 0.5 m step: 11 points."""
    return _medians(series(spark, sf), "v", int(5 / 0.5), 3)


@query(f"WITH {SERIES} SELECT pass, idx, {r(f'avg(g) OVER ({P} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS m FROM s")
def w5_moving_average(spark, sf):
    return series(spark, sf).select("pass", "idx", det_round(windows.moving_average("g", W(), 7)).alias("m"))


@query(f"WITH {SERIES}, b AS (SELECT *, {_fill('g')} FROM s) SELECT pass, idx, {r(LERP)} AS f FROM b")
def f2_linear_fill(spark, sf):
    return series(spark, sf).select("pass", "idx", det_round(windows.linear_fill("g", "pass", "idx")).alias("f"))


@query(f"""WITH {SERIES.replace('event_id % 5 = 0 OR event_id % 7 IN (1, 2)', 'event_id % 5 > 0 AND event_id % 7 > 0')}, b AS (SELECT *, {_fill('g')} FROM s)
  SELECT pass, idx, CASE WHEN least(coalesce(idx - r0, 1000000), coalesce(r1 - idx, 1000000)) <= 3 THEN {r(LERP)} END AS f FROM b""")
def f1_limited_fill(spark, sf):
    rows = series(spark, sf).withColumn("g", F.when((F.col("event_id") % 5 > 0) & (F.col("event_id") % 7 > 0), None).otherwise(F.col("v")))
    return rows.select("pass", "idx", det_round(windows.linear_fill("g", "pass", "idx", limit=3)).alias("f"))


@query(f"""WITH {SERIES}, d AS (SELECT pass, idx, nullif(sign(round(g) - 50), 0) AS sg FROM s)
  SELECT pass, idx, coalesce(last_value(sg IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(sg IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS d FROM d""")
def f3_forward_back_fill(spark, sf):
    rows = series(spark, sf).select("pass", "idx", F.nullif(F.signum(F.round("g") - 50), F.lit(0.0)).cast("int").alias("sg"))
    return rows.select("pass", "idx", windows.forward_back_fill("sg", "pass", "idx", F.lit(0)).alias("d"))


@query(f"""WITH {SERIES}, b AS (SELECT *, {_fill('g')} FROM s), f AS (SELECT pass, idx, {LERP} AS g FROM b), a AS (SELECT *, {_med('g', 5, 1)} AS x FROM f),
  d AS (SELECT *, median(x) OVER (PARTITION BY pass) AS md, stddev_pop(x) OVER (PARTITION BY pass) AS sd FROM a),
  e AS (SELECT *, 1.4826 * median(abs(x - md)) OVER (PARTITION BY pass) AS sc FROM d)
  SELECT pass, idx, {r("coalesce(greatest(least((x - md) / CASE WHEN sc >= 1e-6 THEN sc WHEN sd >= 1e-6 THEN sd ELSE 1 END, 6), -6), 0)", 5)} AS z FROM e""")
def w6_clean_smooth_z(spark, sf):
    rows = series(spark, sf).withColumn("g", windows.linear_fill("g", "pass", "idx"))
    rows = rows.withColumn("x", windows.rolling_median("g", W(), 5, min_periods=1))
    return stats.robust_z(rows, ["pass"], "x").select("pass", "idx", det_round(F.coalesce("z", F.lit(0.0)), 5).alias("z"))


@query(f"""WITH {SERIES}, b AS (SELECT pass, time_bucket(INTERVAL 6 HOUR, ts) AS bin, median(v) AS m, count(*) AS n FROM s GROUP BY ALL),
  e AS (SELECT pass, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY pass), g AS (SELECT pass, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS bin FROM e)
  SELECT g.pass, epoch(g.bin)::BIGINT AS bin_s, {r('m')} AS m, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (pass, bin)""")
def w7_resample_median(spark, sf):
    """Medians of fixed periods; empty periods appear as nulls."""
    out = resample.resample_median(series(spark, sf), ["pass"], "ts", ["v"], 6 * 3600, count="n")
    return out.select("pass", F.col("bin_s"), det_round("v").alias("m"), "n")


@query(f"""WITH {SERIES}, n AS (SELECT pass, count(*) AS n FROM s GROUP BY pass),
  k AS (SELECT DISTINCT pass, round_even(i * (n - 1) / (least(20, n) - 1)::DOUBLE, 0)::BIGINT AS idx FROM n, unnest(range(0, least(20, n))) AS u(i))
  SELECT s.pass, s.idx, s.v FROM s JOIN k USING (pass, idx)""")
def p11_thin_uniform(spark, sf):
    return resample.thin(series(spark, sf), ["pass"], "idx", 20).select("pass", "idx", "v")


@query(f"""WITH {SERIES}, d AS (SELECT pass, v - lag(v) OVER ({P}) AS d FROM s)
  SELECT pass, count(d) AS steps, count(*) FILTER (WHERE d < 0) AS backward, count(*) FILTER (WHERE abs(d) > 100) AS jumps,
    CASE WHEN count(*) FILTER (WHERE d < 0) > 0.6 * count(d) THEN 'severe' WHEN count(*) FILTER (WHERE d < 0) > 0.5 * count(d) THEN 'warning' ELSE 'ok' END AS level FROM d GROUP BY pass""")
def w9_row_difference(spark, sf):
    d = series(spark, sf).select("pass", (F.col("v") - F.lag("v").over(W())).alias("d"))
    back = F.count_if(F.col("d") < 0)
    return d.groupBy("pass").agg(
        F.count("d").alias("steps"), back.alias("backward"), F.count_if(F.abs("d") > 100).alias("jumps"),
        F.when(back > 0.6 * F.count("d"), "severe").when(back > 0.5 * F.count("d"), "warning").otherwise("ok").alias("level"),
    )


@query(f"""WITH {SERIES}, d AS (SELECT *, CASE WHEN event_id % 97 = 5 THEN NULL ELSE v END AS u, t - lag(t) OVER ({P}) AS dt FROM s),
  e AS (SELECT *, 0.5 * (u + lag(u) OVER ({P})) * dt AS st FROM d)
  SELECT pass, idx, CASE WHEN sum(CASE WHEN idx > 0 AND st IS NULL THEN 1 ELSE 0 END) OVER ({P}) = 0 THEN {r(f"sum(coalesce(st, 0)) OVER ({P})", 1)} END AS dist FROM e""")
def w10_trapezoid_poisoned(spark, sf):
    rows = series(spark, sf).withColumn("u", F.when(F.col("event_id") % 97 != 5, F.col("v")))
    return rows.select("pass", "idx", det_round(windows.trapezoid("u", F.col("t") - F.lag("t").over(W()), W(), poison=True), 1).alias("dist"))


@query(f"""WITH {SERIES}, d AS (SELECT *, least(greatest(coalesce(g / 50, 0), 0), 2) AS c, coalesce(t - lag(t) OVER ({P}), 0) AS dt FROM s)
  SELECT pass, idx, {r(f"sum(c * dt) OVER ({P})", 2)} AS dist FROM d""")
def w11_rectangle_sum(spark, sf):
    rows = series(spark, sf).withColumn("u", F.col("g") / 50)
    return rows.select("pass", "idx", det_round(windows.rectangle("u", F.col("t") - F.lag("t").over(W()), W(), 0, 2), 2).alias("dist"))


@query(f"""WITH {SERIES}, a AS (SELECT *, least(coalesce(t - lag(t) OVER ({P}), 0), 10) AS dt, coalesce(g / 100, median(g / 100) OVER (PARTITION BY pass), 0.55) AS sp FROM s),
  b AS (SELECT *, least(greatest({_med('sp', 5, 1)}, 0), 1.6) AS c FROM a) SELECT pass, idx, {r(f"sum(c * dt) OVER ({P})", 8)} AS dist FROM b""")
def w12_speed_distance(spark, sf):
    """Speed with gaps at the pass median (0.55 without one), smoothed, clipped, times steps of 10 s at most."""
    rows = series(spark, sf).withColumn("sp", F.col("g") / 100)
    rows = rows.withColumn("sp", F.coalesce("sp", F.percentile("sp", F.lit(0.5)).over(Window.partitionBy("pass")), F.lit(0.55)))
    rows = rows.withColumn("c", windows.rolling_median("sp", W(), 5, min_periods=1)).withColumn("dt", F.least(F.coalesce(F.col("t") - F.lag("t").over(W()), F.lit(0.0)), F.lit(10.0)))
    return rows.select("pass", "idx", det_round(windows.rectangle("c", F.col("dt"), W(), 0.0, 1.6), 8).alias("dist"))


@query(f"WITH {SERIES} SELECT pass, idx, max(g) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM s")
def w13_running_max(spark, sf):
    return series(spark, sf).select("pass", "idx", F.max("g").over(W().rowsBetween(Window.unboundedPreceding, 0)).alias("m"))


@query(f"""WITH {SERIES}, a AS (SELECT *, lag(v) OVER ({P}) AS v0, lead(v) OVER ({P}) AS v1, t - lag(t) OVER ({P}) AS a, lead(t) OVER ({P}) - t AS b FROM s)
  SELECT pass, idx, {r("CASE WHEN a IS NULL THEN (v1 - v) / b WHEN b IS NULL THEN (v - v0) / a ELSE (a * a * v1 - b * b * v0 + (b * b - a * a) * v) / (a * b * (a + b)) END")} AS g FROM a""")
def w14_gradient(spark, sf):
    return series(spark, sf).select("pass", "idx", det_round(windows.gradient("v", "t", W())).alias("g"))


@query(f"""WITH {SERIES}, a AS (SELECT pass, idx, count(*) OVER q AS n, avg(v) OVER q AS m FROM s WINDOW q AS (PARTITION BY pass ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW))
  SELECT pass, idx, n, {r("m")} AS m FROM a WHERE n >= 8""")
def w15_trailing_time_window(spark, sf):
    rows = series(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    frame = Window.partitionBy("pass").orderBy("us").rangeBetween(-3 * 86400 * 1000000, 0)
    rows = rows.select("pass", "idx", F.count("*").over(frame).alias("n"), F.avg("v").over(frame).alias("m"))
    return rows.where("n >= 8").select("pass", "idx", "n", det_round("m").alias("m"))


@query(f"""WITH {SERIES}, a AS (SELECT pass, idx, sum(coalesce(g, 0)) OVER q AS s, count(g) OVER q / 12.0 AS ok FROM s WINDOW q AS ({P} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  SELECT pass, idx, {r("s - 40 * (1 - ok)", 4)} AS score FROM a""")
def w16_sliding_sum(spark, sf):
    frame = W().rowsBetween(-11, 0)
    score = F.sum(F.coalesce("g", F.lit(0.0))).over(frame) - 40 * (1 - F.count("g").over(frame) / 12)
    return series(spark, sf).select("pass", "idx", det_round(score, 4).alias("score"))


@query(f"""WITH {SERIES}, f AS (SELECT pass, idx, v < 60 AS low FROM s), i AS (SELECT *, idx - row_number() OVER (PARTITION BY pass, low ORDER BY idx) AS isl FROM f),
  u AS (SELECT pass, isl, min(idx) AS start, count(*) AS n FROM i WHERE low GROUP BY ALL HAVING count(*) >= 4) SELECT pass, min(start) AS start, arg_min(n, start) AS n FROM u GROUP BY pass""")
def w17_first_sustained_run(spark, sf):
    """First run of at least 4 low rows of each pass."""
    rows = series(spark, sf).withColumn("low", F.col("v") < 60)
    _, island = windows.run_starts(F.col("low"), "pass", "idx")
    runs = rows.withColumn("isl", island).where("low").groupBy("pass", "isl").agg(F.min("idx").alias("start"), F.count("*").alias("n")).where("n >= 4")
    return runs.groupBy("pass").agg(F.min("start").alias("start"), F.min_by("n", "start").alias("n"))


# ---- interpolation joins: purchases are the source, views the query rows
def _asof_sql(clamp: bool) -> str:
    inner = "CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END"
    value = f"coalesce({inner}, v0, v1)" if clamp else inner
    return f"""WITH {SERIES}, q AS (SELECT * FROM s WHERE event_type = 'view'), p AS (SELECT pass, t, avg(v) AS v FROM s WHERE event_type = 'purchase' GROUP BY ALL),
  a AS (SELECT q.pass, q.idx, q.t, p.v AS v0, p.t AS t0 FROM q ASOF LEFT JOIN p ON q.pass = p.pass AND q.t >= p.t),
  b AS (SELECT a.*, p.v AS v1, p.t AS t1 FROM a ASOF LEFT JOIN p ON a.pass = p.pass AND a.t <= p.t)
  SELECT pass, idx, {r(value)} AS v FROM b"""


def _asof(spark, sf, clamp):
    rows = series(spark, sf).where(F.col("event_type").isin("view", "purchase")).withColumn("q", F.col("event_type") == "view")
    return windows.asof_linear(rows, "pass", "t", ["v"], "q", clamp).select("pass", "idx", det_round("v").alias("v"))


@query(_asof_sql(True))
def j2_asof_linear_clamped(spark, sf):
    return _asof(spark, sf, True)


@query(_asof_sql(False))
def j3_asof_linear(spark, sf):
    return _asof(spark, sf, False)


@query(f"""WITH x AS ({_asof_sql(False).replace('floor((', '((').replace(') * 1e6 + 0.5) / 1e6', '))')}), y AS (SELECT *, {_med('v', 5, 3)} AS md FROM x), z AS (SELECT *, {_fill('md')} FROM (SELECT *, idx AS k FROM y))
  SELECT pass, idx, {r(f"least(greatest(({LERP}) / 100, 0), 1.6)")} AS v FROM z""")
def j4_speed_interpolation(spark, sf):
    """Interpolated, smoothed by a 5-point median, filled, clipped to [0, 1.6]."""
    rows = series(spark, sf).where(F.col("event_type").isin("view", "purchase")).withColumn("q", F.col("event_type") == "view")
    rows = windows.asof_linear(rows, "pass", "t", ["v"], "q", False)
    rows = rows.withColumn("md", windows.rolling_median("v", W(), 5))
    value = F.least(F.greatest(windows.linear_fill("md", "pass", "idx") / 100, F.lit(0.0)), F.lit(1.6))
    return rows.select("pass", "idx", det_round(value).alias("v"))


# ---- all passes of a kind as one long series, in blocks of 512 rows
LONG = "PARTITION BY event_type ORDER BY t, event_id"
LONG_ROWS = 512


def _long(spark, sf):
    return series(spark, sf).select("event_type", "event_id", "g", "v", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


@query(f"""WITH {SERIES}, e AS (SELECT event_type, event_id, g, epoch_us(ts) AS t FROM s),
  b AS (SELECT *, last_value(g IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN g IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0,
    first_value(g IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN g IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1
    FROM e WINDOW p AS ({LONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS ({LONG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  f AS (SELECT *, coalesce(g, CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1) AS f FROM b)
  SELECT event_type, event_id, {r('f')} AS linear, CASE WHEN least(coalesce(t - t0, t1 - t), coalesce(t1 - t, t - t0)) <= 3000000000 THEN {r('f')} END AS limited, coalesce(v0, v1) AS held FROM f""")
def f1_f2_f3_long_series(spark, sf):
    """Fills of series that many tasks share: linear, linear up to 50 minutes from a value, and forward then backward."""
    fills = {"linear": ("g", "linear", None), "limited": ("g", "linear", 3e9), "held": ("g", "hold", None)}
    rows = long_series.fill(_long(spark, sf), ["event_type"], "t", fills, ["event_id"], rows=LONG_ROWS)
    return rows.select("event_type", "event_id", det_round("linear").alias("linear"), det_round("limited").alias("limited"), "held")


@query(f"""WITH e AS (SELECT event_id, event_type, user_id % 3 AS track, epoch_us(ts) AS t, value AS v FROM events), q AS (SELECT * FROM e WHERE event_type = 'view'),
  p AS (SELECT track, t, max(v) AS v FROM e WHERE event_type = 'purchase' GROUP BY ALL),
  a AS (SELECT q.event_id, q.track, q.t, p.v AS v0, p.t AS t0 FROM q ASOF LEFT JOIN p ON q.track = p.track AND q.t >= p.t),
  b AS (SELECT a.*, p.v AS v1, p.t AS t1 FROM a ASOF LEFT JOIN p ON a.track = p.track AND a.t <= p.t)
  SELECT event_id, track, {r('CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END')} AS v FROM b""")
def j2_j3_long_series(spark, sf):
    """The interpolating as-of join of three long tracks, in blocks."""
    rows = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    rows = rows.select("event_id", (F.col("user_id") % 3).alias("track"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"), (F.col("event_type") == "view").alias("q"))
    return long_series.asof_linear(rows, ["track"], "t", ["v"], "q", False, rows=LONG_ROWS).select("event_id", "track", det_round("v").alias("v"))


# ---- normalisation
Z = "PARTITION BY pass"


@query(f"WITH {SERIES} SELECT pass, idx, {r(f'(v - avg(v) OVER ({Z})) / stddev_pop(v) OVER ({Z})')} AS z FROM s")
def n1_z_score(spark, sf):
    return series(spark, sf).select("pass", "idx", det_round(stats.z_score("v", Window.partitionBy("pass"))).alias("z"))


def _rz(v: str, clip: bool, src: str = "s") -> str:
    z = f"({v} - md) / CASE WHEN sc >= 1e-6 THEN sc WHEN sd >= 1e-6 THEN sd ELSE 1 END"
    z = f"greatest(least({z}, 6), -6)" if clip else z
    return f"""d AS (SELECT *, median({v}) OVER ({Z}) AS md, stddev_pop({v}) OVER ({Z}) AS sd FROM {src}),
  e AS (SELECT *, 1.4826 * median(abs({v} - md)) OVER ({Z}) AS sc FROM d), z AS (SELECT *, {z} AS z FROM e)"""


@query(f"WITH {SERIES}, {_rz('v', True)} SELECT pass, idx, {r('z')} AS z FROM z")
def n2_robust_z(spark, sf):
    return stats.robust_z(series(spark, sf), ["pass"], "v").select("pass", "idx", det_round("z").alias("z"))


@query(f"WITH {SERIES}, {_rz('v', True)} SELECT DISTINCT pass, {r('md')} AS center, {r('CASE WHEN sc >= 1e-6 THEN sc WHEN sd >= 1e-6 THEN sd ELSE 1 END')} AS scale FROM z")
def n3_center_scale(spark, sf):
    rows = stats.with_mad(series(spark, sf), ["pass"], "v")
    scale = F.first("mad") * stats.MAD_SCALE
    return rows.groupBy("pass").agg(
        det_round(F.first("med")).alias("center"),
        det_round(F.when(scale >= 1e-6, scale).when(F.stddev_pop("v") >= 1e-6, F.stddev_pop("v")).otherwise(1.0)).alias("scale"),
    )


@query(f"WITH {SERIES}, {_rz('v', False)} SELECT pass, idx, {r('z')} AS z FROM z")
def n5_robust_z_unclipped(spark, sf):
    return stats.robust_z(series(spark, sf), ["pass"], "v", clip=None, least=1e-9).select("pass", "idx", det_round("z").alias("z"))


@query(f"""WITH {SERIES}, st AS (SELECT pass, median(v) AS md FROM s WHERE event_type = 'view' GROUP BY pass),
  st2 AS (SELECT s.pass, any_value(md) AS md, 1.4826 * median(abs(v - md)) AS sc FROM s JOIN st USING (pass) WHERE event_type = 'view' GROUP BY s.pass)
  SELECT s.pass, idx, {r('greatest(least((v - md) / CASE WHEN sc >= 1e-6 THEN sc ELSE 1 END, 6), -6)')} AS z FROM s JOIN st2 USING (pass)""")
def n6_robust_z_reference(spark, sf):
    """Robust z of every row by the statistics of the pass's reference rows (views)."""
    rows = series(spark, sf)
    ref = stats.with_mad(rows.where("event_type = 'view'"), ["pass"], "v").groupBy("pass").agg(F.first("med").alias("md"), (stats.MAD_SCALE * F.first("mad")).alias("sc"))
    z = (F.col("v") - F.col("md")) / F.when(F.col("sc") >= 1e-6, F.col("sc")).otherwise(1.0)
    return rows.join(ref, "pass").select("pass", "idx", det_round(F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0))).alias("z"))


@query(f"WITH {SERIES} SELECT pass, idx, {r('v - (' + _med('v', 71, 17) + ')')} AS h FROM s")
def n10_high_pass(spark, sf):
    """35 m at a 0.5 m step: 71 points."""
    return _high_pass(series(spark, sf), "v", int(35 / 0.5))


@query(f"WITH {SERIES} SELECT pass, idx, {r('v - (' + _med('v', 15, 3) + ')')} AS h FROM s")
def n12_high_pass_time(spark, sf):
    """60 s at a 4 s period: 15 points."""
    return _high_pass(series(spark, sf), "v", round(60 / 4))


@query(f"""WITH {SERIES}, {GRID}, a AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY pass ORDER BY cell ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS sm, count(v) OVER (PARTITION BY pass ORDER BY cell ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS k FROM m),
  b AS (SELECT *, CASE WHEN k >= 3 THEN sm END AS f, lag(sm) OVER (PARTITION BY pass ORDER BY cell) AS p0, lead(sm) OVER (PARTITION BY pass ORDER BY cell) AS p1, 0.5 * (cell - lag(cell) OVER (PARTITION BY pass ORDER BY cell)) AS a0, 0.5 * (lead(cell) OVER (PARTITION BY pass ORDER BY cell) - cell) AS a1 FROM a)
  SELECT pass, cell, {r('f')} AS smooth, {r("CASE WHEN a0 IS NULL THEN (p1 - f) / a1 WHEN a1 IS NULL THEN (f - p0) / a0 ELSE (a0 * a0 * p1 - a1 * a1 * p0 + (a1 * a1 - a0 * a0) * f) / (a0 * a1 * (a0 + a1)) END")} AS grad FROM b""")
def n15_smoothed_map_gradient(spark, sf):
    w = by_pass("pass", "cell")
    rows = grid(spark, sf).withColumn("f", windows.rolling_median("v", w, 11, divisor=3))
    return rows.select("pass", "cell", det_round("f").alias("smooth"), det_round(windows.gradient("f", F.col("cell") * 0.5, w)).alias("grad"))


@query(f"""WITH {SERIES}, h AS (SELECT pass, time_bucket(INTERVAL 1 HOUR, ts) AS bin, median(v) AS v FROM s GROUP BY ALL), x AS (SELECT pass, bin, v, row_number() OVER (PARTITION BY pass ORDER BY bin) AS idx FROM h),
  y AS (SELECT *, v - ({_med('v', 9, 3)}) AS hp FROM x), {_rz('hp', True, 'y')}
  SELECT pass, count(z) AS bins, {r('avg(z)', 5)} AS mean_z, {r('quantile_cont(abs(z), 0.9)', 5)} AS p90_z, {r('sqrt(avg(hp * hp))', 5)} AS rmse FROM z GROUP BY pass""")
def flagship(spark, sf):
    """Hourly medians, high-pass by rolling median, robust z, summary of each pass."""
    hours = resample.resample_median(series(spark, sf), ["pass"], "ts", ["v"], 3600, dense=False)
    rows = hours.withColumn("idx", F.row_number().over(by_pass("pass", "bin_s")))
    rows = rows.withColumn("hp", windows.high_pass("v", W(), 9))
    z = stats.robust_z(rows, ["pass"], "hp")
    return z.groupBy("pass").agg(
        F.count("z").alias("bins"), det_round(F.avg("z"), 5).alias("mean_z"), det_round(F.percentile(F.abs("z"), F.lit(0.9)), 5).alias("p90_z"), det_round(stats.rmse("hp"), 5).alias("rmse")
    )
