"""Queries of the feature bundles, references, and window and pass matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, stats, windows
from ..functions.scalars import det_round
from ..functions.windows import by_pass
from ..operators import features, maps, matching, resample, similarity
from .registry import GRID, SERIES, grid, query, r, series, table
from .results import RES, per_segment, res, rounded
from .signal import LERP, W, _fill, _med, _rz

C = "PARTITION BY pass ORDER BY cell"


# ---- standardised vectors
@query(f"""WITH {SERIES}, a AS (SELECT pass, idx, v, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd, median(v) OVER w AS md FROM s WINDOW w AS (PARTITION BY pass)), b AS (SELECT *, 1.4826 * median(abs(v - md)) OVER (PARTITION BY pass) AS sc FROM a)
  SELECT pass, idx, {r('CASE WHEN sc >= 1e-9 THEN (v - md) / sc WHEN sd >= 1e-9 THEN (v - mu) / sd ELSE 0 END')} AS z FROM b""")
def n4_robust_or_plain_z(spark, sf):
    return stats.robust_or_plain_z(series(spark, sf), ["pass"], "v").select("pass", "idx", det_round("z").alias("z"))


@query(f"WITH {SERIES}, {_rz('v', True)} SELECT pass, {r('sqrt(avg(z * z))')} AS rmse, {r('max(abs(z))')} AS top FROM z GROUP BY pass")
def x6_x7_vector_metrics(spark, sf):
    return stats.robust_z(series(spark, sf), ["pass"], "v").groupBy("pass").agg(det_round(stats.rmse("z")).alias("rmse"), det_round(stats.max_abs("z")).alias("top"))


ROWS8 = """ro AS (SELECT pass, idx // 8 AS line, list(CASE WHEN event_type = 'signup' THEN 5.0 ELSE v END ORDER BY idx) AS w FROM s GROUP BY ALL)"""


@query(f"""WITH {SERIES}, {ROWS8}, z AS (SELECT pass, line, CASE WHEN list_stddev_pop(w) >= 1e-6 THEN list_transform(w, lambda x: (x - list_avg(w)) / list_stddev_pop(w)) END AS z FROM ro)
  SELECT pass, line, {r('list_sum(list_transform(z, lambda x: abs(x)))', 4)} AS size, {r('z[1]', 4)} AS head FROM z""")
def n7_row_standardise(spark, sf):
    """Rows of a matrix (eight samples of a pass) standardised one by one."""
    v = F.when(F.col("event_type") == "signup", 5.0).otherwise(F.col("v"))
    rows = series(spark, sf).groupBy("pass", F.floor(F.col("idx") / 8).alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", v.alias("v")))), lambda t: t["v"]).alias("w"))
    rows = rows.withColumn("z", arrays.standardise(F.col("w"), 1e-6))
    return rows.select("pass", "line", det_round(arrays.total(F.transform("z", lambda x: F.abs(x))), 4).alias("size"), det_round(F.get("z", F.lit(0)), 4).alias("head"))


OK = "sum((g IS NOT NULL)::INT) OVER (PARTITION BY pass) >= {share} * count(*) OVER (PARTITION BY pass)"


@query(f"""WITH {SERIES}, b AS (SELECT *, {_fill('g')} FROM s), f AS (SELECT pass, idx, CASE WHEN {OK.format(share=0.55)} THEN {LERP} END AS f FROM b)
  SELECT pass, idx, {r('(f - avg(f) OVER w) / stddev_pop(f) OVER w', 5)} AS z FROM f WINDOW w AS (PARTITION BY pass)""")
def n8_vector_standardise(spark, sf):
    return features.vector_standardise(series(spark, sf), ["pass"], "idx", "g", share=0.55).select("pass", "idx", det_round("z", 5).alias("z"))


@query(f"""WITH {SERIES}, b AS (SELECT *, {_fill('g')} FROM s), f AS (SELECT pass, idx, CASE WHEN {OK.format(share=0.55)} THEN {LERP} END AS f FROM b), {_rz('f', True, 'f')} SELECT pass, idx, CASE WHEN f IS NOT NULL THEN {r('z', 5)} END AS z FROM z""")
def n9_window_robust_z(spark, sf):
    return features.window_robust_z(series(spark, sf), ["pass"], "idx", "g", share=0.55).select("pass", "idx", det_round("z", 5).alias("z"))


STEP = """st AS (SELECT pass, idx, t, v, t - lag(t) OVER (PARTITION BY pass ORDER BY idx) AS d FROM s), pt AS (SELECT pass, greatest(3, floor({m} / median(d) FILTER (WHERE d > 0))::INT) AS p0 FROM st GROUP BY pass), pp AS (SELECT pass, p0 + 1 - p0 % 2 AS p FROM pt),
  la AS (SELECT pass, list({v} ORDER BY idx) AS a FROM s GROUP BY pass),
  hp AS (SELECT s.pass, s.idx, s.t, s.v, {v} AS o, list_slice(a, greatest(s.idx - p // 2, 0) + 1, s.idx + p // 2 + 1) AS w, greatest(3, p // 4) AS least FROM s JOIN pp USING (pass) JOIN la USING (pass))"""
MED = "CASE WHEN len(list_filter(w, lambda x: x IS NOT NULL)) >= least THEN list_median(w) END"


@query(f"WITH {SERIES}, {STEP.format(m='200000', v='v')} SELECT pass, idx, {r(f'v - ({MED})')} AS hp FROM hp")
def n11_adaptive_high_pass(spark, sf):
    """High-pass over 200,000 s of passes whose steps differ."""
    rows = series(spark, sf).withColumn("x", F.struct("t", "idx"))
    out = features.adaptive_high_pass(rows.select("pass", "t", "v"), ["pass"], "t", "v", 200000.0)
    return out.join(rows.select("pass", "t", "idx"), ["pass", "t"]).select("pass", "idx", det_round("hp").alias("hp"))


TRACKS = f"""{SERIES}, bd AS (SELECT pass, idx, v AS x, v * (1 + idx % 3) AS y, (event_id % 100)::DOUBLE AS z, CASE WHEN pass % 2 = 0 THEN 1 ELSE -1 END AS dir FROM s), fl AS (SELECT *, sqrt(x * x + y * y + z * z) AS f FROM bd),
  tf AS (SELECT pass, idx, -(x - median(x) OVER w) * dir AS tx, (y - median(y) OVER w) * dir AS ty, z - median(z) OVER w AS tz, f - median(f) OVER w AS total FROM fl WINDOW w AS (PARTITION BY pass))"""


def _tracks(spark, sf):
    rows = series(spark, sf).select("pass", "idx", F.col("v").alias("x"), (F.col("v") * (1 + F.col("idx") % 3)).alias("y"), (F.col("event_id") % 100).cast("double").alias("z"), F.when(F.col("pass") % 2 == 0, 1).otherwise(-1).alias("dir"))
    return features.track_features(rows, "pass", "idx", "dir", "x", "y", "z", (11, 15))


@query(f"WITH {TRACKS} SELECT pass, idx, {r('tx')} AS tx, {r('ty')} AS ty, {r('tz')} AS tz, {r('total')} AS total, {r('total - (' + _med('total', 11, 3) + ')')} AS hp, {r('ty - (' + _med('ty', 15, 3) + ')')} AS hp_y FROM tf")
def n13_track_features(spark, sf):
    return rounded(_tracks(spark, sf), ["pass", "idx"], "tx", "ty", "tz", "total", "hp", "hp_y", digits=6)


@query(f"WITH {SERIES} SELECT pass, idx, {r('g')} AS anomaly, {r('g - (' + _med('g', 11, 3) + ')')} AS hp FROM s")
def n14_legacy_features(spark, sf):
    return rounded(features.legacy_features(series(spark, sf), "pass", "idx", "g", 11), ["pass", "idx"], "anomaly", "hp", digits=6)


@query(f"""WITH {SERIES}, {STEP.format(m='200000', v='v')}, k AS (SELECT pass, count(g) >= 0.55 * count(*) AS ok, list(g ORDER BY idx) AS ga FROM s GROUP BY pass),
  q AS (SELECT hp.*, p, ok, list_slice(ga, greatest(idx - p // 2, 0) + 1, idx + p // 2 + 1) AS gw, ga[idx + 1] AS g FROM hp JOIN pp USING (pass) JOIN k USING (pass)),
  u AS (SELECT *, lag(v) OVER o AS v0, lead(v) OVER o AS v1, t - lag(t) OVER o AS a, lead(t) OVER o - t AS b FROM q WINDOW o AS (PARTITION BY pass ORDER BY idx))
  SELECT pass, idx, {r(f'v - ({MED})')} AS hp, {r('CASE WHEN a IS NULL THEN (v1 - v) / b WHEN b IS NULL THEN (v - v0) / a ELSE -(b / (a * (a + b))) * v0 + ((b - a) / (a * b)) * v + (a / (b * (a + b))) * v1 END', 5)} AS grad,
    {r('CASE WHEN ok AND len(list_filter(gw, lambda x: x IS NOT NULL)) >= least THEN g - list_median(gw) END')} AS hp_other FROM u""")
def n16_query_features(spark, sf):
    rows = series(spark, sf)
    out = features.query_features(rows.select("pass", "t", "v", "g"), ["pass"], "t", "v", "g", 200000.0, share=0.55)
    return out.join(rows.select("pass", "t", "idx"), ["pass", "t"]).select("pass", "idx", det_round("hp").alias("hp"), det_round("grad", 5).alias("grad"), det_round("hp_other").alias("hp_other"))


BINS = """h AS (SELECT pass, epoch(time_bucket(INTERVAL 4 HOUR, ts))::BIGINT AS b, median(v) AS v FROM s GROUP BY ALL), ev AS (SELECT pass, unnest(range(min(b), max(b) + 1, 14400)) AS b FROM h GROUP BY pass),
  x AS (SELECT ev.pass, ev.b, h.v, row_number() OVER (PARTITION BY ev.pass ORDER BY ev.b) - 1 AS idx FROM ev LEFT JOIN h USING (pass, b))"""


@query(f"""WITH {SERIES}, {BINS}, f0 AS (SELECT *, {_fill('v')} FROM x), f AS (SELECT pass, idx, CASE WHEN least(coalesce(idx - r0, 1000000), coalesce(r1 - idx, 1000000)) <= 3 THEN {LERP} END AS v, max(idx) OVER (PARTITION BY pass) + 1 AS n FROM f0),
  sp AS (SELECT pass, unnest(range(0, least(any_value(n), 60))) AS i, any_value(n) AS n FROM f GROUP BY pass), pk AS (SELECT DISTINCT pass, CASE WHEN n > 60 THEN round_even(i * (n - 1) / 59.0, 0) ELSE i END::BIGINT AS idx FROM sp),
  t0 AS (SELECT f.pass, f.idx AS cell, f.v, row_number() OVER (PARTITION BY f.pass ORDER BY f.idx) - 1 AS idx FROM f JOIN pk USING (pass, idx)) SELECT pass, cell, {r(_med('v', 7, 3))} AS v FROM t0""")
def w8_fixed_period_queries(spark, sf):
    """Four-hour medians, short gaps filled, at most 60 points of each pass, smoothed."""
    bins = resample.resample_median(series(spark, sf), ["pass"], "ts", ["v"], 4 * 3600)
    rows = resample.number_rows(bins, "pass", ["bin_s"]).withColumn("v", windows.linear_fill("v", "pass", "idx", limit=3))
    rows = resample.number_rows(resample.thin(rows, ["pass"], "idx", 60).withColumnRenamed("idx", "cell"), "pass", ["cell"])
    return rows.select("pass", "cell", det_round(windows.rolling_median("v", W(), 7, divisor=3)).alias("v"))


# ---- grids
@query(f"""WITH {SERIES}, {GRID}, sp AS (SELECT pass, min(cell) AS lo, max(cell) AS hi FROM m GROUP BY pass), b AS (SELECT max(hi) AS top, quantile_cont(lo, 0.5) AS lo, quantile_cont(hi, 0.5) AS hi FROM sp), f AS (SELECT unnest(range(0, least(900, top) * 2 + 1)) AS half, lo, hi FROM b)
  SELECT half, half * 0.5 AS x, half * 0.5 BETWEEN lo AND hi AS common FROM f""")
def x3_x4_grids(spark, sf):
    """The full half-metre grid, and which of its points most passes cover."""
    return maps.full_and_common_grid(grid(spark, sf), "pass", "cell", 0.5, 900)


@query(f"WITH {SERIES}, {GRID} SELECT cell, count(*) AS n, {r('avg(v)')} AS mean, {r('median(v)')} AS median, {r('max(v) FILTER (WHERE pass = 3)')} AS pass_3, {r('max(v) FILTER (WHERE pass = 7)')} AS pass_7 FROM m GROUP BY cell")
def m2_wide_map(spark, sf):
    """Statistics of all passes beside the channels of two, as an export has them."""
    return rounded(maps.wide_map(grid(spark, sf), [3, 7]), ["cell", "n"], "mean", "median", "pass_3", "pass_7", digits=6)


WIDE = f"WITH {SERIES}, {GRID} SELECT cell, 'pass_' || pass AS channel, {r('v', 3)} AS v FROM m WHERE pass IN (3, 7, 11)"


def _wide_lines(spark, sf):
    wide = maps.wide_map(grid(spark, sf), [3, 7, 11])
    return wide.select(F.array_join(F.array(F.col("cell").cast("string"), *[F.coalesce(F.format_string("%.9f", f"pass_{p}"), F.lit("")) for p in (3, 7, 11)]), ",").alias("value"))


@query(WIDE)
def s13_wide_map_scan(spark, sf):
    """Lines of a wide map CSV, whose columns depend on the passes, to long rows."""
    names = ["cell", *[f"pass_{p}" for p in (3, 7, 11)]]
    rows = _wide_lines(spark, sf).select(F.from_csv("value", ", ".join(f"{n} {'long' if n == 'cell' else 'double'}" for n in names)).alias("t")).select("t.*")
    return maps.long_map(rows, "cell", "pass_").select("cell", "channel", det_round("v", 3).alias("v")).where("v is not null")


@query(f"WITH {SERIES}, {GRID}, w AS (SELECT cell, max(v) FILTER (WHERE pass = 3) AS a, max(v) FILTER (WHERE pass = 7) AS b FROM m GROUP BY cell) SELECT cell, {r('a + b')} AS both FROM w")
def p9_column_regex(spark, sf):
    """Columns of a wide map by a pattern of their names."""
    wide = maps.wide_map(grid(spark, sf), [3, 7])
    picked = [n for n in wide.select(wide.colRegex("`^pass_[0-9]+$`")).columns]
    return wide.select("cell", det_round(sum((F.col(n) for n in picked[1:]), F.col(picked[0]))).alias("both"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_custkey AS owner, NULL::BIGINT AS part FROM orders UNION ALL SELECT 'customer', c_custkey, c_nationkey, NULL FROM customer UNION ALL SELECT 'line', l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1""")
def p12_e38_compact_union(spark, sf):
    """A few columns of three sources as one table."""
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    k = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("owner"))
    li = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("part"))
    return o.unionByName(k, allowMissingColumns=True).unionByName(li, allowMissingColumns=True)


@query(f"""WITH {RES}, per AS (SELECT segment, method, sqrt(avg(err * err)) AS rmse FROM res GROUP BY ALL), l AS (SELECT segment, '| ' || method || ' | ' || printf('%.2f', floor(rmse * 100 + 0.5) / 100) || ' |' AS line FROM per)
  SELECT segment, '| method | rmse |' || chr(10) || '|-|-|' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS note FROM l GROUP BY segment""")
def k3_markdown_notes(spark, sf):
    """A segment's results as a Markdown table."""
    per = res(spark, sf).groupBy("segment", "method").agg(stats.rmse("err").alias("rmse"))
    line = F.concat(F.lit("| "), "method", F.lit(" | "), F.format_string("%.2f", det_round("rmse", 2)), F.lit(" |"))
    return per.groupBy("segment").agg(F.concat(F.lit("| method | rmse |\n|-|-|\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("note"))


# ---- features on the map's cells, and references made of them
FT = f"""{SERIES}, {GRID}, fa AS (SELECT pass, cell, v - median(v) OVER (PARTITION BY pass) AS total, v - (CASE WHEN count(v) OVER w9 >= 3 THEN quantile_cont(v, 0.5) OVER w9 END) AS hp,
    CASE WHEN lag(v) OVER o IS NULL THEN (lead(v) OVER o - v) / 0.5 WHEN lead(v) OVER o IS NULL THEN (v - lag(v) OVER o) / 0.5 ELSE lead(v) OVER o - lag(v) OVER o END AS grad FROM m WINDOW o AS ({C}), w9 AS ({C} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
  fu AS (SELECT pass, cell, 'total' AS f, total AS v FROM fa UNION ALL SELECT pass, cell, 'hp', hp FROM fa UNION ALL SELECT pass, cell, 'grad', grad FROM fa),
  fd AS (SELECT *, median(v) OVER z AS md, stddev_pop(v) OVER z AS sd FROM fu WINDOW z AS (PARTITION BY pass, f)), fe AS (SELECT *, 1.4826 * median(abs(v - md)) OVER (PARTITION BY pass, f) AS sc FROM fd),
  ft AS (SELECT pass, cell, f, greatest(least((v - md) / CASE WHEN sc >= 1e-6 THEN sc WHEN sd >= 1e-6 THEN sd ELSE 1 END, 6), -6) AS v FROM fe)"""
FREF = "fr AS (SELECT cell, f, avg(v) AS v FROM ft GROUP BY ALL)"


def feats(spark, sf):
    return features.map_features(grid(spark, sf))


BAD = [3, 5, 8]


@query(f"WITH {FT}, g AS (SELECT cell, f, avg(v) AS good FROM ft WHERE pass NOT IN (3, 5, 8) GROUP BY ALL), {FREF} SELECT fr.cell, fr.f, {r('v')} AS every, {r('good')} AS good FROM fr JOIN g USING (cell, f)")
def m3_axis_reference(spark, sf):
    """Mean features of all passes and of those of good quality."""
    ft = feats(spark, sf)
    good = features.feature_reference(ft, spark.createDataFrame([(x,) for x in BAD], "pass long")).withColumnRenamed("v", "good")
    return features.feature_reference(ft).join(good, ["cell", "f"]).select("cell", "f", det_round("v").alias("every"), det_round("good").alias("good"))


@query(f"""WITH {FT}, {FREF}, s5 AS (SELECT cell, f, quantile_cont(v, 0.5) OVER (PARTITION BY f ORDER BY cell ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM fr),
  a AS (SELECT *, median(v) OVER z AS md, stddev_pop(v) OVER z AS sd FROM s5 WINDOW z AS (PARTITION BY f)), b AS (SELECT *, 1.4826 * median(abs(v - md)) OVER (PARTITION BY f) AS sc FROM a)
  SELECT cell, f, {r('greatest(least((v - md) / CASE WHEN sc >= 1e-6 THEN sc WHEN sd >= 1e-6 THEN sd ELSE 1 END, 6), -6)')} AS v FROM b""")
def m4_hmm_reference(spark, sf):
    return features.hmm_reference(features.feature_reference(feats(spark, sf))).select("cell", "f", det_round("v").alias("v"))


SETS = {"even": "pass % 2 = 0", "odd": "pass % 2 = 1", "third": "pass % 3 = 0", "first_half": "pass < 8", "all": "pass >= 0"}
SETS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS name, pass FROM (SELECT DISTINCT pass FROM m) WHERE {v}" for k, v in SETS.items())


def _sets(spark, sf):
    names = F.filter(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in SETS.items()]), lambda x: x.isNotNull())
    return grid(spark, sf).select("pass").distinct().withColumn("name", F.explode(names))


@query(f"WITH {SERIES}, {GRID}, st AS ({SETS_SQL}) SELECT name, cell, {r('median(v)')} AS v FROM m JOIN st USING (pass) GROUP BY ALL")
def m5_reference_family(spark, sf):
    """Maps of named, overlapping sets of passes."""
    return features.reference_family(grid(spark, sf), _sets(spark, sf)).select("name", "cell", det_round("v").alias("v"))


@query(f"""WITH {SERIES}, {GRID}, k AS (SELECT 0 AS pass, cell, median(v) AS v FROM m GROUP BY cell), {FT.replace(f'{SERIES}, {GRID}, ', '').replace('FROM m ', 'FROM k ')} SELECT cell, f, {r('v', 5)} AS v FROM ft""")
def m6_fused_map_features(spark, sf):
    """Total, high-pass and gradient of the fused map."""
    fused = maps.stack(grid(spark, sf), "median").withColumn("pass", F.lit(0).cast("long"))
    return features.map_features(fused).select("cell", "f", det_round("v", 5).alias("v"))


QUAL = """q AS (SELECT pass, abs(avg(v) - 60) / 5 AS e, 0.3 + (pass % 9) / 10.0 AS sc FROM m GROUP BY pass), w AS (SELECT pass, e <= 2 AND sc >= 0.6 AS ok, 0.15 + 0.85 * exp(-((e / 50) ** 2)) * least(greatest((sc - 0.35) / 0.35, 0), 1) AS weight FROM q)"""


@query(f"""WITH {SERIES}, {GRID}, {QUAL}, h AS (SELECT cell, median(v) AS hard FROM m JOIN w USING (pass) WHERE ok GROUP BY cell),
  c AS (SELECT cell, v, sum(weight) OVER (PARTITION BY cell ORDER BY v) AS run, sum(weight) OVER (PARTITION BY cell) AS tot FROM m JOIN w USING (pass)), sf AS (SELECT cell, min(v) AS soft FROM c WHERE run >= 0.5 * tot GROUP BY cell)
  SELECT cell, {r('hard')} AS hard, {r('soft')} AS soft FROM sf LEFT JOIN h USING (cell)""")
def m8_m9_quality_references(spark, sf):
    """The median of accepted passes, and the median weighted by quality."""
    g = grid(spark, sf)
    q = g.groupBy("pass").agg((F.abs(F.avg("v") - 60) / 5).alias("e"), (0.3 + (F.first("pass") % 9) / 10.0).alias("sc"))
    hard, soft = maps.quality_references(g, q, "e", "sc")
    return soft.join(hard, "cell", "left").select("cell", det_round("hard").alias("hard"), det_round("soft").alias("soft"))


# ---- correlation of passes
ARR = "av AS (SELECT pass, list(v ORDER BY cell) AS q FROM m GROUP BY pass)"


@query(f"""WITH {SERIES}, {GRID}, g AS (SELECT pass, cell, CASE WHEN (pass + cell) % 9 < 3 THEN NULL ELSE v END AS v FROM m), rf AS (SELECT cell, avg(v) AS rv FROM m GROUP BY cell),
  x AS (SELECT g.pass, g.v, rf.rv, count(g.v) OVER (PARTITION BY pass) AS n, count(*) OVER (PARTITION BY pass) AS k FROM g JOIN rf USING (cell)),
  y AS (SELECT pass, v, rv, n, k, median(v) OVER p AS mv, median(rv) OVER p AS mr FROM x WHERE v IS NOT NULL WINDOW p AS (PARTITION BY pass)), z AS (SELECT *, 1.4826 * median(abs(v - mv)) OVER p AS sv, 1.4826 * median(abs(rv - mr)) OVER p AS sr FROM y WINDOW p AS (PARTITION BY pass))
  SELECT pass, n, {r('CASE WHEN n >= greatest(8, 0.6 * k) THEN corr(v, rv) END', 5)} AS ncc, {r('CASE WHEN n >= 0.6 * k THEN corr(greatest(least((v - mv) / sv, 6), -6), greatest(least((rv - mr) / sr, 6), -6)) END', 5)} AS robust FROM z GROUP BY pass, n, k""")
def c1_c37_pair_correlation(spark, sf):
    """Normalised correlation and robust correlation of passes with gaps against the mean map."""
    g = grid(spark, sf)
    gaps = g.withColumn("v", F.when((F.col("pass") + F.col("cell")) % 9 < 3, None).otherwise(F.col("v")))
    both = gaps.join(g.groupBy("cell").agg(F.avg("v").alias("rv")), "cell")
    return similarity.gated_correlations(both, "pass", "v", "rv", 8, 0.6).select("pass", "n", det_round("ncc", 5).alias("ncc"), det_round("robust", 5).alias("robust"))


def _day(k: int) -> str:
    return f"d{k} AS (SELECT cell, f, avg(v) AS v FROM ft WHERE pass % 2 = {k} GROUP BY ALL), e{k} AS (SELECT *, CASE WHEN lag(v) OVER o IS NULL THEN (lead(v) OVER o - v) / 0.5 WHEN lead(v) OVER o IS NULL THEN (v - lag(v) OVER o) / 0.5 ELSE lead(v) OVER o - lag(v) OVER o END AS g FROM d{k} WINDOW o AS (PARTITION BY f ORDER BY cell))"


@query(f"""WITH {FT}, {_day(0)}, {_day(1)}, j AS (SELECT f, cell, a.v AS va, b.v AS vb, a.g AS ga, b.g AS gb FROM e0 a JOIN e1 b USING (cell, f)), u AS (SELECT *, va - vb - median(va - vb) OVER (PARTITION BY f) AS u FROM j)
  SELECT f, count(*) AS n, {r('corr(va, vb)', 5)} AS corr, {r('corr(ga, gb)', 5)} AS derivative_corr, {r('sqrt(avg(u * u))', 5)} AS rms_unbiased FROM u GROUP BY f""")
def c3_c6_cross_date(spark, sf):
    """Similarity of two days' maps in each feature: values, derivatives, errors without bias."""
    day = lambda k: features.feature_reference(feats(spark, sf).where(F.col("pass") % 2 == k))
    return similarity.cross_date(day(0), day(1), ["f"], "cell", "v", 0.5).select("f", "n", *[det_round(x, 5).alias(x) for x in ("corr", "derivative_corr", "rms_unbiased")])


# ---- windows against the reference, in several features
def _win(n: int, stride: int, src: str = "ft", key: str = "pass, ") -> str:
    w = f"(PARTITION BY {key}f ORDER BY cell ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""SELECT {key}f, start, list_transform(w, lambda x: (x - list_avg(w)) / list_stddev_pop(w)) AS w FROM (SELECT {key}f, cell AS start, list(v) OVER {w} AS w, count(*) OVER {w} AS k FROM {src}) WHERE k = {n} AND start % {stride} = 0"""


def _scored(n: int, stride: int, mode: str, names: str) -> str:
    dot = f"list_dot_product(q.w, p.w) / {n}" if mode == "ncc" else f"-list_sum(list_transform(list_zip(q.w, p.w), lambda t: (t[1] - t[2]) ** 2)) / {n}"
    return f"SELECT q.pass, q.start, p.start AS s, avg({dot}) AS c FROM ({_win(n, stride)}) q JOIN ({_win(n, 1, 'fr', '')}) p USING (f) WHERE f IN ({names}) GROUP BY ALL"


def _best(src: str, zone: float, where: str = "true") -> str:
    return f"SELECT b.pass, b.start, any_value(pred) AS pred, any_value(best) AS best, max(c) FILTER (WHERE abs(s - pred) >= {zone}) AS second FROM (SELECT pass, start, arg_min(s, (-floor(c * 1e9 + 0.5), s)) AS pred, max(c) AS best FROM {src} WHERE {where} GROUP BY ALL) b JOIN {src} USING (pass, start) WHERE {where} GROUP BY ALL"


THREE = ["grad", "hp", "total"]
THREE_SQL = ", ".join(f"'{x}'" for x in THREE)


def _scores(spark, sf, n, stride, **variants):
    ft = feats(spark, sf)
    return matching.window_scores(ft, features.feature_reference(ft), ["pass"], n, stride, variants)


@query(f"WITH {FT}, {FREF}, sc AS ({_scored(16, 8, 'ncc', THREE_SQL)}), b AS ({_best('sc', 10)}), p AS ({_best('sc', 10, 'abs(s - start) <= 12')}) SELECT b.pass, b.start, b.pred, {r('b.best', 5)} AS best, {r('b.second', 5)} AS second, p.pred AS near_pred, {r('p.best', 5)} AS near_best FROM b JOIN p USING (pass, start)")
def c9_c11_c13_feature_match(spark, sf):
    """Windows of three features against the reference, freely and within a radius of the true place."""
    sc = _scores(spark, sf, 16, 8, scores=(THREE, "ncc")).withColumn("_n", matching.top_entry(matching.near_only("scores", F.col("start"), 12)))
    got = matching.best_of(sc, ["pass", "start", "_n"], 10)
    return got.select("pass", "start", "pred", det_round("best", 5).alias("best"), det_round("second", 5).alias("second"), (-F.col("_n.m")).alias("near_pred"), det_round("_n.score", 5).alias("near_best"))


@query(f"WITH {FT}, {FREF}, sc AS ({_scored(12, 12, 'msd', THREE_SQL)}) SELECT pass, start, count(*) AS tries, {r('max(c)', 5)} AS top, {r('avg(c)', 5)} AS mean FROM sc GROUP BY ALL")
def c28_score_vectors(spark, sf):
    """The scores of all reference starts by squared difference."""
    sc = _scores(spark, sf, 12, 12, scores=(THREE, "msd")).select("pass", "start", F.transform("scores", lambda t: t["score"]).alias("c"))
    return sc.select("pass", "start", F.size("c").cast("long").alias("tries"), det_round(F.array_max("c"), 5).alias("top"), det_round(arrays.mean(F.col("c")), 5).alias("mean"))


VALID = [(n, mode, names) for n in (12, 16) for mode in ("ncc", "msd") for names in (["total"], THREE)]
PRIORS = (None, 10)


def _valid_sql() -> str:
    parts = []
    for i, (n, mode, names) in enumerate(VALID):
        parts.append(f"v{i} AS ({_scored(n, n, mode, ', '.join(repr(x) for x in names))})")
    rows = []
    for i, (n, mode, names) in enumerate(VALID):
        for radius in PRIORS:
            near = "true" if radius is None else f"abs(s - start) <= {radius}"
            rows.append(f"SELECT {n} AS n, '{mode}' AS mode, '{'+'.join(names)}' AS features, {radius or 0} AS radius, count(*) AS queries, median(abs(pred - start)) AS median_abs, avg((abs(pred - start) <= 2)::INT) AS hits FROM (SELECT pass, start, arg_min(s, (-floor(c * 1e9 + 0.5), s)) AS pred FROM v{i} WHERE {near} GROUP BY ALL)")
    return f"WITH {FT}, {FREF}, {', '.join(parts)} SELECT n, mode, features, radius, queries, {r('median_abs', 4)} AS median_abs, {r('hits', 4)} AS hits FROM ({' UNION ALL '.join(rows)})"


@query(_valid_sql())
def c10_validation(spark, sf):
    """Variants by windows by priors: every configuration's errors over all query windows."""
    out = None
    for n in sorted({n for n, _, _ in VALID}):
        variants = {f"{mode}_{len(names)}": (names, mode) for k, mode, names in VALID if k == n}
        sc = _scores(spark, sf, n, n, **variants)
        tried = [
            F.struct(F.lit(mode).alias("mode"), F.lit("+".join(names)).alias("features"), F.lit(radius or 0).alias("radius"), F.abs(matching.top_entry(matching.near_only(name, F.col("start"), radius))["m"] + F.col("start")).alias("e"))
            for name, (names, mode) in variants.items() for radius in PRIORS
        ]
        rows = sc.select(F.lit(n).alias("n"), F.explode(F.array(*tried)).alias("t")).select("n", "t.*")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("n", "mode", "features", "radius").agg(F.count("*").alias("queries"), det_round(stats.median("e"), 4).alias("median_abs"), det_round(stats.share(F.col("e") <= 2), 4).alias("hits"))


@query(f"""WITH {FT}, {FREF}, cq AS (SELECT pass, start, flatten(list(w ORDER BY f)) AS w FROM ({_win(16, 8)}) GROUP BY ALL), cr AS (SELECT start AS s, flatten(list(w ORDER BY f)) AS w FROM ({_win(16, 1, 'fr', '')}) GROUP BY ALL),
  sc AS (SELECT pass, start, s, list_dot_product(cq.w, cr.w) / 48 AS c FROM cq, cr), b AS ({_best('sc', 10)}) SELECT pass, start, pred, {r('best', 5)} AS best, {r('second', 5)} AS second FROM b""")
def c12_concatenated_ncc(spark, sf):
    """Correlation of the features laid end to end; the runner-up stands at max(10, half a window) or further."""
    sc = _scores(spark, sf, 16, 8, scores=(THREE, "ncc"))
    return matching.best_of(sc, ["pass", "start"], max(10, 16 // 2)).select("pass", "start", "pred", det_round("best", 5).alias("best"), det_round("second", 5).alias("second"))


# ---- passes laid out by relative distance
SCALES = [0.5, 0.75, 1.0]


def _tries(source: str, scales: list[float], step: int, share: float = 0.85, ref: str = "rf") -> str:
    """(key, scale, s, c) of laying ``source`` (key, i, d, q) out on the map by lines between its cells."""
    return f"""SELECT key, scale, s, corr(q, x) AS c FROM (SELECT p.key, scale, st.s, p.q, n, CASE WHEN st.s + scale * d = a.cell THEN a.rv ELSE a.rv + (b.rv - a.rv) * (st.s + scale * d - a.cell) END AS x
    FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {source}) p, (SELECT unnest([{', '.join(map(str, scales))}])::DOUBLE AS scale), (SELECT unnest(range(0, 48, {step})) AS s) st
      JOIN {ref} a ON a.cell = floor(st.s + scale * d)::BIGINT JOIN {ref} b ON b.cell = least(a.cell + 1, 47) WHERE st.s + scale * d <= 47)
    GROUP BY key, scale, s HAVING count(*) >= ceil({share} * any_value(n)) AND count(*) >= 3 AND corr(q, x) IS NOT NULL AND NOT isnan(corr(q, x))"""


def _pick(src: str, zone: int) -> str:
    return f"""SELECT b.key, any_value(b.start) AS start, any_value(b.scale) AS scale, any_value(best) AS score, max(c) FILTER (WHERE abs(s - b.start) >= {zone}) AS second FROM (SELECT key, arg_min(s, (-floor(c * 1e9 + 0.5), s, scale)) AS start, arg_min(scale, (-floor(c * 1e9 + 0.5), s, scale)) AS scale, max(c) AS best FROM {src} GROUP BY key) b JOIN {src} USING (key) GROUP BY b.key"""


RFM = "rf AS (SELECT cell, avg(v) AS rv FROM m GROUP BY cell)"


def _reference(spark, sf):
    return grid(spark, sf).groupBy("cell").agg(F.avg("v").alias("v"))


def _laid(spark, sf):
    """All cells of each pass by distance from its begin."""
    return matching.pass_arrays(grid(spark, sf), ["pass"]).withColumn("rel", F.transform("c", lambda x: x.cast("double")))


@query(f"WITH {SERIES}, {GRID}, {RFM}, qq AS (SELECT pass AS key, cell, cell::DOUBLE AS d, v AS q FROM m), t AS ({_tries('qq', SCALES, 2)}), b AS ({_pick('t', 8)}) SELECT key AS pass, start, scale, {r('score', 5)} AS score, {r('second', 5)} AS second FROM b")
def c29_c30_start_search(spark, sf):
    """Start and scale of each pass by correlation with the map."""
    got = matching.best_try(matching.search_starts(_laid(spark, sf), _reference(spark, sf), ["pass"], SCALES, 2), ["pass"], 8)
    return got.select("pass", F.col("start").cast("long").alias("start"), "scale", det_round("score", 5).alias("score"), det_round("second", 5).alias("second"))


LENGTHS = [24, 34, 44]


@query(f"WITH {SERIES}, {GRID}, {RFM}, qq AS (SELECT pass AS key, cell, cell / 47.0 AS d, v AS q FROM m), t AS ({_tries('qq', LENGTHS, 2)}), b AS ({_pick('t', 8)}) SELECT key AS pass, start, scale AS length, {r('score', 5)} AS score FROM b")
def c31_time_scale_search(spark, sf):
    """The length that a pass covers, from a sweep of assumed lengths."""
    rows = _laid(spark, sf).withColumn("rel", F.transform("rel", lambda x: x / 47.0))
    got = matching.best_try(matching.search_starts(rows, _reference(spark, sf), ["pass"], [float(x) for x in LENGTHS], 2), ["pass"], 8)
    return got.select("pass", F.col("start").cast("long").alias("start"), F.col("scale").alias("length"), det_round("score", 5).alias("score"))


SPANS = [10, 14]


@query(f"""WITH {SERIES}, {GRID}, {RFM}, le AS (SELECT unnest({SPANS}) AS len), fi AS (SELECT unnest(range(0, 48, 10)) AS first), qq AS (SELECT (pass, len, first) AS key, cell, (cell - first)::DOUBLE AS d, v AS q FROM m, le, fi WHERE cell BETWEEN first AND first + len - 1 AND first + len <= 48),
  t AS ({_tries('qq', [1.0], 1)}), b AS ({_pick('t', 8)}), u AS (SELECT key[1] AS pass, key[2] AS len, key[3] AS first, start, score, score - coalesce(second, 0) AS margin FROM b), k AS (SELECT *, margin + 0.25 * score + 0.0005 * len AS merit FROM u)
  SELECT pass, len, first, start, {r('score', 5)} AS score, {r('margin', 5)} AS margin FROM (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY floor(merit * 1e9 + 0.5) DESC, len, first) AS rk FROM k) WHERE rk = 1""")
def c32_c34_distinctive_window(spark, sf):
    """The stretch of each pass, over lengths and places, that the map tells best from other places."""
    spans = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(s).alias("first")) for n in SPANS for s in range(0, 48, 10) if s + n <= 48])
    rows = grid(spark, sf).withColumn("w", F.explode(spans)).select("pass", "cell", "v", "w.*").where("cell >= first and cell < first + len")
    arr = matching.pass_arrays(rows, ["pass", "len", "first"]).withColumn("rel", F.transform("c", lambda x: (x - F.col("first")).cast("double")))
    got = matching.best_try(matching.search_starts(arr, _reference(spark, sf), ["pass", "len", "first"], [1.0], 1), ["pass", "len", "first"], 8)
    best = matching.distinctive(got, ["pass"], "len")
    return best.select("pass", "len", "first", F.col("start").cast("long").alias("start"), det_round("score", 5).alias("score"), det_round("margin", 5).alias("margin"))


@query(f"WITH {SERIES}, {GRID}, {RFM}, qq AS (SELECT pass AS key, cell, cell::DOUBLE AS d, v AS q FROM m), t AS ({_tries('qq', [0.9, 1.0, 1.1], 1, 0.9)}), b AS ({_pick('t', 2)}) SELECT key AS pass, start, scale, {r('score', 5)} AS score FROM b")
def c33_c35_whole_pass_alignment(spark, sf):
    """A whole pass against all starts; nine tenths of it must lie on the map."""
    got = matching.best_try(matching.search_starts(_laid(spark, sf), _reference(spark, sf), ["pass"], [0.9, 1.0, 1.1], 1, share=0.9), ["pass"], 2)
    return got.select("pass", F.col("start").cast("long").alias("start"), "scale", det_round("score", 5).alias("score"))


@query(f"""WITH {SERIES}, {GRID}, tt AS (SELECT cell, sum(v) AS s, count(*) AS n FROM m GROUP BY cell), lo AS (SELECT h.pass, tt.cell, (tt.s - coalesce(o.v, 0)) / (tt.n - (o.v IS NOT NULL)::INT) AS rv FROM (SELECT DISTINCT pass FROM m) h CROSS JOIN tt LEFT JOIN m o ON o.pass = h.pass AND o.cell = tt.cell),
  qq AS (SELECT pass, cell, v FROM m WHERE cell BETWEEN 10 AND 30), t AS (SELECT qq.pass AS key, 1.0 AS scale, st.s, corr(qq.v, lo.rv) AS c FROM qq, (SELECT unnest(range(0, 48)) AS s) st JOIN lo ON lo.cell = st.s + qq.cell - 10 AND lo.pass = qq.pass GROUP BY ALL HAVING count(*) = 21), b AS ({_pick('t', 8)})
  SELECT key AS pass, start, {r('score', 5)} AS score, {r('second', 5)} AS second FROM b""")
def c36_left_out_match(spark, sf):
    """A stretch of each pass against the map of all other passes."""
    own = matching.without_own(grid(spark, sf))
    stretch = grid(spark, sf).where(F.col("cell").between(10, 30))  # the feature: a stretch of a pass is looked for
    rows = matching.pass_arrays(stretch, ["pass"]).withColumn("rel", F.transform("c", lambda x: (x - 10).cast("double"))).join(own, "pass")
    got = matching.best_try(matching.search_starts(rows, None, ["pass"], [1.0], 1, share=1.0), ["pass"], 8)
    return got.select("pass", F.col("start").cast("long").alias("start"), det_round("score", 5).alias("score"), det_round("second", 5).alias("second"))


# ---- evaluation against references
@query(f"""WITH {SERIES}, {GRID}, st AS ({SETS_SQL}), rfm AS (SELECT name, cell, median(v) AS rv FROM m JOIN st USING (pass) GROUP BY ALL), j AS (SELECT name, m.pass, m.v, rv FROM m JOIN rfm USING (cell)), u AS (SELECT *, v - rv - median(v - rv) OVER (PARTITION BY name, pass) AS u FROM j)
  SELECT u.name, u.pass, (any_value(st.pass) IS NOT NULL)::INT AS in_reference, count(*) AS n, {r('CASE WHEN count(*) >= 20 THEN corr(v, rv) END', 5)} AS corr, {r('sqrt(avg(u * u))', 5)} AS rms FROM u LEFT JOIN st ON st.name = u.name AND st.pass = u.pass GROUP BY ALL""")
def c21_e22_e23_reference_evaluation(spark, sf):
    """Every pass against every candidate map, and whether it is part of it."""
    g, sets = grid(spark, sf), _sets(spark, sf)
    family = features.reference_family(g, sets).withColumnRenamed("v", "rv")
    got = similarity.unbiased(g.join(family, "cell"), ["name", "pass"], "v", "rv")
    member = sets.withColumn("in_reference", F.lit(1))
    out = got.join(member, ["name", "pass"], "left")
    return out.select("name", "pass", F.coalesce("in_reference", F.lit(0)).alias("in_reference"), "n", det_round(F.when(F.col("n") >= 20, F.col("corr")), 5).alias("corr"), det_round("rms_unbiased", 5).alias("rms"))


# ---- velocity, distance, slices
@query(f"WITH {SERIES} SELECT pass, idx, {r('0.8 * v + 0.6 * (event_id % 100)')} AS vel FROM s")
def v27_track_velocity(spark, sf):
    """East and north velocity projected on the track's unit vector."""
    rows = series(spark, sf).withColumn("e", F.col("v")).withColumn("n", (F.col("event_id") % 100).cast("double"))
    return rows.select("pass", "idx", det_round(features.projected("e", "n", 0.8, 0.6)).alias("vel"))


@query(f"""WITH {SERIES}, k AS (SELECT *, 0.8 * v + 0.6 * (event_id % 100) AS vel FROM s), a AS (SELECT *, CASE WHEN count(vel) OVER w7 >= 3 THEN quantile_cont(vel, 0.5) OVER w7 END AS md FROM k WINDOW w7 AS (PARTITION BY pass ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  u AS (SELECT pass, t, median(md) AS md FROM a WHERE event_type <> 'view' GROUP BY ALL), q AS (SELECT pass, idx, t FROM a WHERE event_type = 'view'),
  x AS (SELECT q.*, u.t AS t0, u.md AS v0 FROM q ASOF LEFT JOIN u ON q.pass = u.pass AND q.t >= u.t), y AS (SELECT x.*, u.t AS t1, u.md AS v1 FROM x ASOF LEFT JOIN u ON x.pass = u.pass AND x.t <= u.t)
  SELECT pass, idx, {r('CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END', 5)} AS vel FROM y""")
def j5_track_velocity_asof(spark, sf):
    """Signed velocity, smoothed by seven points, at the times of other rows."""
    rows = series(spark, sf).withColumn("vel", features.projected(F.col("v"), (F.col("event_id") % 100).cast("double"), 0.8, 0.6))
    rows = rows.withColumn("vel", windows.rolling_median("vel", W(), 7)).withColumn("q", F.col("event_type") == "view")
    return windows.asof_linear(rows, "pass", "t", ["vel"], "q", False).select("pass", "idx", det_round("vel", 5).alias("vel"))


@query(f"""WITH {SERIES}, sp AS (SELECT pass AS seg, min(ts) AS t0, max(ts) AS t1 FROM s WHERE idx BETWEEN 20 AND 40 GROUP BY pass), x AS (SELECT seg, s.pass, s.idx, s.v FROM s JOIN sp ON s.ts BETWEEN t0 AND t1 WHERE s.v BETWEEN 10 AND 90) SELECT seg, count(*) AS n, {r('avg(v)')} AS mean_v FROM x GROUP BY seg""")
def j6_align_all_passes(spark, sf):
    """Samples of all sensors in the time range of every pass, clipped to a range: counts and sums between the two ends of each."""
    from ..operators import series as long_series

    rows = series(spark, sf).withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    spans = rows.where(F.col("idx").between(20, 40)).groupBy(F.col("pass").alias("seg")).agg(F.min("sec").alias("t0"), F.max("sec").alias("t1"))
    got = long_series.range_totals(rows.where("v between 10 and 90"), "sec", "v", spans, "seg", "t0", "t1")
    return got.select("seg", "n", det_round(F.col("total").cast("double") / F.col("n")).alias("mean_v"))


@query(f"WITH {SERIES}, d AS (SELECT pass, idx, g, t - lag(t) OVER (PARTITION BY pass ORDER BY idx) AS dt FROM s), f AS (SELECT pass, idx, CASE WHEN g IS NOT NULL THEN least(greatest(g / 100, 0), 2) END AS sp, dt FROM d), e AS (SELECT *, lag(sp) OVER (PARTITION BY pass ORDER BY idx) AS s0 FROM f) SELECT pass, {r('coalesce(sum(0.5 * (sp + s0) * dt), 0)', 4)} AS metres FROM e GROUP BY pass")
def e10_imu_distance(spark, sf):
    """Distance of each pass: trapezoids of the speed clipped to [0, 2]; missing samples add nothing."""
    speed = F.when(F.col("g").isNotNull(), F.least(F.greatest(F.col("g") / 100, F.lit(0.0)), F.lit(2.0)))
    rows = series(spark, sf).withColumn("sp", speed).withColumn("dt", F.col("t") - F.lag("t").over(W()))
    rows = rows.withColumn("part", 0.5 * (F.col("sp") + F.lag("sp").over(W())) * F.col("dt"))
    return rows.groupBy("pass").agg(det_round(F.coalesce(F.sum("part"), F.lit(0.0)), 4).alias("metres"))


PROG = f"""{RES}, p AS (SELECT segment, method, abs(arg_max(err, id) - arg_min(err, id)) AS p FROM res GROUP BY ALL), i AS (SELECT segment, avg(abs(err)) AS i FROM res GROUP BY segment), k AS (SELECT segment, method, abs(ln((p + 10) / (i + 10))) AS compat FROM p JOIN i USING (segment))"""


@query(f"WITH {PROG} SELECT t.segment, CASE WHEN a.compat < t.compat THEN 'axis' ELSE 'total' END AS source, {r('least(a.compat, t.compat)')} AS compat FROM k t JOIN k a USING (segment) WHERE t.method = '1-URGENT' AND a.method = '5-LOW'")
def e11_progress_closest(spark, sf):
    """The axis candidate where its progress fits the distance strictly better, the total candidate elsewhere."""
    from ..operators import evaluate

    rows = res(spark, sf)
    prog = rows.groupBy("segment", "method").agg(F.abs(F.max_by("err", "id") - F.min_by("err", "id")).alias("progress"))
    both = evaluate.with_compat(prog.join(rows.groupBy("segment").agg(F.avg(F.abs("err")).alias("imu")), "segment"), "progress", "imu")
    return evaluate.progress_closest(both.where("method = '1-URGENT'"), both.where("method = '5-LOW'"), "segment").select("segment", "source", det_round("compat").alias("compat"))


@query(f"""WITH {SERIES}, {BINS}, f0 AS (SELECT *, {_fill('v')} FROM x), f AS (SELECT pass, idx, CASE WHEN least(coalesce(idx - r0, 1000000), coalesce(r1 - idx, 1000000)) <= 3 THEN {LERP} END AS v FROM f0),
  ok AS (SELECT pass FROM f GROUP BY pass HAVING count(v) >= 40), y AS (SELECT pass, idx, v - ({_med('v', 15, 3)}) AS hp FROM f WHERE pass IN (SELECT pass FROM ok)), {_rz('hp', True, 'y')} SELECT pass, idx, CASE WHEN hp IS NOT NULL THEN {r('z', 5)} END AS z FROM z""")
def v28_query_bundle(spark, sf):
    """Passes resampled, filled, chosen, high-passed and standardised, as the trackers take them."""
    bins = resample.resample_median(series(spark, sf), ["pass"], "ts", ["v"], 4 * 3600)
    rows = resample.number_rows(bins, "pass", ["bin_s"]).withColumn("v", windows.linear_fill("v", "pass", "idx", limit=3))
    rows = rows.withColumn("_n", F.count("v").over(Window.partitionBy("pass"))).where("_n >= 40").withColumn("hp", windows.high_pass("v", W(), 15))
    return stats.robust_z(rows, ["pass"], "hp").select("pass", "idx", det_round("z", 5).alias("z"))


@query(f"WITH {SERIES} SELECT pass, CASE WHEN pass % 2 = 0 THEN idx - 12 ELSE 40 - idx END AS idx, event_id FROM s WHERE idx BETWEEN 12 AND 40")
def v29_query_slice(spark, sf):
    """Rows 12 to 40 of each pass, numbered in its direction of travel."""
    rows = series(spark, sf).where(F.col("idx").between(12, 40))
    return rows.select("pass", F.when(F.col("pass") % 2 == 0, F.col("idx") - 12).otherwise(40 - F.col("idx")).alias("idx"), "event_id")
