"""Parsers, fills, geometry, selection and streaming on small fixtures."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import stats, windows
from fieldtrace.functions.scalars import number_after
from fieldtrace.functions.windows import by_pass
from fieldtrace.operators import evaluate, geometry, joins, resample
from fieldtrace.sources import logs
from fieldtrace.streaming import online


def test_golden_position_sentence(spark):
    rows = [("$GPGGA,010203.50,3030.0000,N,11415.0000,E,4,12,0.8,25.0",), ("$GPGGA,015959.9999996,3030.0,S,11415.0,W,,,,",), ("$GPGGA,1",), ("$GPGGA,010203,x,N,1,E,1,1,1,1",)]
    got = logs.parse_gpgga(spark.createDataFrame(rows, "value string"), F.lit("2026-05-13")).collect()
    assert [(r.time, r.lat, r.lon, r.fix_quality) for r in got] == [(dt.datetime(2026, 5, 13, 9, 2, 3, 500000), 30.5, 114.25, 4), (dt.datetime(2026, 5, 13, 10, 0), -30.5, -114.25, 0)]
    assert got[1].hdop is None and got[1].satellites == 0


def test_limited_fill_is_pandas_interpolation(spark):
    rng = np.random.default_rng(0)
    frames = []
    for p in range(30):
        v = rng.normal(size=40)
        v[rng.random(40) < 0.6] = np.nan
        frames.append(pd.DataFrame({"p": p, "i": np.arange(40), "v": v}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = df.select("p", "i", windows.linear_fill("v", "p", "i", limit=3).alias("f")).toPandas().sort_values(["p", "i"])
    want = pdf.groupby("p")["v"].transform(lambda s: s.interpolate(limit=3, limit_direction="both"))
    np.testing.assert_allclose(got["f"].to_numpy(dtype=float), want.to_numpy(), atol=1e-12)


def test_asof_is_np_interp(spark):
    xp, fp = np.array([1.0, 4.0, 9.0]), np.array([2.0, -1.0, 5.0])
    xq = np.array([0.0, 1.0, 2.5, 8.0, 9.0, 11.0])
    rows = [(1, float(x), float(y), False) for x, y in zip(xp, fp, strict=True)] + [(1, float(x), None, True) for x in xq]
    df = spark.createDataFrame(rows, "k int, x double, v double, q boolean")
    got = windows.asof_linear(df, "k", "x", ["v"], "q", clamp=True).orderBy("x").toPandas()["v"].to_numpy()
    np.testing.assert_allclose(got, np.interp(xq, xp, fp))
    outside = windows.asof_linear(df, "k", "x", ["v"], "q", clamp=False).orderBy("x").toPandas()["v"].to_numpy()
    assert np.isnan(outside[[0, -1]].astype(float)).all()


def test_gradient_is_np_gradient(spark):
    x = np.array([0.0, 1.0, 3.0, 3.5, 7.0])
    v = x**2
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, v, strict=True))], "p int, i int, x double, v double")
    got = df.select("i", windows.gradient("v", "x", by_pass("p", "i")).alias("g")).orderBy("i").toPandas()["g"]
    np.testing.assert_allclose(got, np.gradient(v, x))


def test_robust_z_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0)] * 4, "p int, v double")
    assert [r.z for r in stats.robust_z(df, ["p"], "v").collect()] == [0.0] * 4


def test_weighted_median_with_ties_and_bad_weights(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 2.0, 1.0), (1, 9.0, 0.0), (1, None, 5.0)], "k int, v double, w double")
    assert stats.weighted_median(df, ["k"], "v", "w").collect()[0].wmedian == 2.0


def test_axis_fit_follows_a_line(spark):
    t = np.linspace(0, 500, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": 3 + 0.6 * t, "y": -2 + 0.8 * t}))
    r = geometry.track_axis(df, "x", "y").first()
    assert abs(r.ux) == pytest.approx(0.6, abs=1e-6) and abs(r.uy) == pytest.approx(0.8, abs=1e-6)
    s = geometry.along_track(df, geometry.track_axis(df, "x", "y"), "x", "y").agg(F.max("s") - F.min("s")).first()[0]
    assert s == pytest.approx(500)


def test_direction_segments_find_the_turn(spark):
    s = np.concatenate([np.linspace(0, 200, 120), np.linspace(200, 0, 120)])
    df = spark.createDataFrame(pd.DataFrame({"p": 1, "t": np.arange(240.0), "s": s}))
    got = [(r.direction, r.start, r.stop) for r in geometry.split_by_direction(df, "p", "t", "s").orderBy("part").collect()]
    assert [g[0] for g in got] == [1, -1] and abs(got[0][2] - 120) <= 16


def test_unknown_variant_and_missing_number(spark):
    with pytest.raises(ValueError):
        geometry.permute("x", "y", "z", "d", "nothing")
    with pytest.raises(Exception, match="no vmax"):
        spark.createDataFrame([("a",)], "m string").select(number_after("m", "vmax")).collect()
    with pytest.raises(Exception, match="no row"):
        joins.lookup(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2, "x")], "k int, v string"), ["k"]).collect()


def test_argmax_prefers_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 5.0), (1, 2, 5.0), (1, 20, 4.0)], "k int, p int, s double")
    r = evaluate.argmax_with_runner_up(df, "k", "s", "p", 10).first()
    assert (r.position, r.best, r.second) == (1, 5.0, 4.0)


def test_separated_top(spark):
    df = spark.createDataFrame([(1, 0.0, 3.0), (1, 10.0, 2.9), (1, 60.0, 2.0), (1, 200.0, 1.0)], "k int, p double, s double")
    assert [r.position for r in evaluate.separated_top(df, "k", "s", "p", 2, 50).orderBy("rank").collect()] == [0.0, 60.0]


def test_thin_keeps_ends(spark):
    df = spark.createDataFrame([(1, i) for i in range(11)], "k int, i long")
    assert [r.i for r in resample.thin(df, ["k"], "i", 3).orderBy("i").collect()] == [0, 5, 10]


def test_sinks_and_optional_source(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    logs.write_csv(df, str(tmp_path / "x"), bom=True)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "x").glob("*.csv"))
    assert "﻿" in text and "a" in text
    assert json.loads(logs.records_json(df).first().json)["records"][1] == {"k": 2, "v": "b"}
    assert logs.optional_parquet(spark, str(tmp_path / "none"), "k int").count() == 0


def test_files_are_read_with_their_names(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "log_GPGGA.ascii").write_text("$GPGGA,010203.50,3030.0000,N,11415.0000,E,4,12,0.8,25.0\nnoise\n")
    lines = logs.read_lines(spark, str(tmp_path), pattern="*GPGGA*")
    assert logs.inventory(lines).first().rows == 2
    assert logs.parse_gpgga(lines, F.lit("2026-05-13"), 0, "file").count() == 1
    (tmp_path / "m.dat").write_text("Time,X,Y,Z,P,R,Y2\n20260513010203004.0,3,4,12,0,0,0\nbad,1,1,1,1,1,1\n")
    r = logs.read_magnetometer(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].mag_total == 13.0 and r[0].time == dt.datetime(2026, 5, 13, 1, 2, 3, 4000)


def test_interval_join_equals_the_plain_condition(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame(pd.DataFrame({"t": rng.uniform(0, 100, 200)}))
    spans = spark.createDataFrame(pd.DataFrame({"a": np.arange(0.0, 90, 9), "b": np.arange(0.0, 90, 9) + 13}))
    got = joins.interval_join(pts, "t", spans, "a", "b", 5.0, slack=1.0).count()
    assert got == pts.join(spans, F.expr("t >= a - 1 and t <= b + 1")).count()


def test_fixed_lag_stream_matches_the_batch(spark, tmp_path):
    from fieldtrace.operators import kernels

    ref, dist = np.sin(np.arange(20) / 2), np.arange(20.0)
    obs = ref[3:18]
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(1, int(k), float(obs[k])) for k in range(i * 5, i * 5 + 5)], "k long, i long, v double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k long, i long, v double").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = online.fixed_lag_stream(stream, "k", "i", "v", dist, ref, lag=4, vmax=1.0, period=1.0, sigma=0.2)
    q = out.writeStream.format("memory").queryName("lagged").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r.i: r.pred for r in spark.table("lagged").collect()}
    want = dist[kernels.fixed_lag(kernels.log_likelihood(obs, ref, 0.2), dist, np.ones(15), 1.0, 4)]
    assert got == {i: want[i] for i in range(11)}


def test_windowed_stream_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "ev")
    at = lambda h: dt.datetime(2026, 1, 1, h)
    for batch in ([(at(1), 1, 1.0), (at(9), 1, 2.0)], [(at(10), 1, 5.0)], [(at(1), 1, 7.0), (at(12), 1, 3.0)], [(at(20), 1, 4.0)], [(at(21), 1, 4.0)]):
        spark.createDataFrame(batch, "ts timestamp, k int, v double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, k int, v double").option("maxFilesPerTrigger", 1).parquet(src)
    out = online.windowed_summary(stream, "ts", "k", "v", lateness="2 hours")
    q = out.writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r.start.hour: (r.n, r["mean"]) for r in spark.table("hourly").collect()}
    assert got[1] == (1, 1.0) and got[9] == (1, 2.0)


def test_hypotheses_are_chosen_by_each_mode(spark):
    from fieldtrace.operators import sweeps

    rows = [(1, 0, 9.0, 0.9, 0.1, 0.1, 0.5, 0.6, 3.0), (1, 1, 8.0, 0.8, 0.7, 0.0, 0.9, 0.9, 5.0), (1, 2, 9.0, 0.9, 0.7, 0.0, 0.1, 0.1, 7.0)]
    df = spark.createDataFrame(rows, "pass long, place long, score double, per_sample double, median double, p10 double, trim20 double, trim35 double, median_abs double")
    got = {r["mode"]: (r.place, r.median_abs) for r in sweeps.choose_hypotheses(df).collect()}
    assert got == {"sum": (0, 3.0), "per_sample": (0, 3.0), "median": (1, 5.0), "p10": (0, 3.0), "trim20": (1, 5.0), "trim35": (1, 5.0), "hybrid": (1, 5.0)}
