"""Equal choices are decided by the rule that the SQL states, whatever the last digits of a sum are."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import geometry, matching, sweeps


def test_scores_equal_up_to_nine_decimals_take_the_first_place(spark):
    df = spark.sql("select array(named_struct('s', 4L, 'score', 0.5D), named_struct('s', 7L, 'score', 0.5D + 1e-15D), named_struct('s', 9L, 'score', 0.4D)) as k")
    assert df.select(-matching.top_entry("k")["m"]).first()[0] == 4


def test_scales_of_scores_equal_up_to_nine_decimals_take_the_smaller(spark):
    df = spark.createDataFrame([("a", 0.75, 9.9, 1.0), ("a", 1.5, 9.9 + 4e-15, 2.0)], "k string, scale double, score double, median_abs double")
    assert sweeps.scale_posterior(df, "k", "scale", "score", [0]).first()["lambda_0"] == 0.75


def test_rows_of_one_time_stand_in_the_given_order(spark):
    rows = [(1, i, float(i // 4), float(i if i < 60 else 120 - i) * 5) for i in range(120)]
    df = spark.createDataFrame(rows, "pass long, idx long, t double, s double")
    got = [sorted(geometry.split_by_direction(d, "pass", "t", "s", spacing=15, least_rows=10, duration_s=5, order="idx").collect()) for d in (df, df.orderBy(F.desc("idx")))]
    assert got[0] == got[1] and len(got[0]) == 2
