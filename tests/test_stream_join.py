"""The as-of join of streams with rows in any order within the lateness, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.streaming import asof


@pytest.mark.parametrize("clamp", [False, True])
def test_late_rows_and_open_ends(spark, tmp_path, clamp):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 10_000), int(rng.random() < 0.4), i, float(rng.randint(0, 50))) for k in ("a", "b", "c") for i in range(120)]
    rows += [("d", 500, asof.QUERY, 0, 0.0), ("e", 500, asof.SOURCE, 0, 7.0)]
    arrived = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 300))
    parts = [arrived[i * len(arrived) // 4 : (i + 1) * len(arrived) // 4] for i in range(4)]
    parts.append([(k, 10_000, asof.CLOSE, None, None) for k in "abcde"] + [("a", 11_000, asof.TICK, None, None)])
    own = asof.store_session(spark)
    for p in parts:
        rng.shuffle(p)
        df = own.createDataFrame(p, "track string, sec long, kind int, id long, v double")
        df.withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "track string, sec long, kind int, id long, v double, ts timestamp"
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = asof.run_available(asof.asof_stream(stream, "track", "ts", "310 seconds", clamp), str(tmp_path))
    seen = [(r.track, r.id, r.v) for r in got.collect()]
    want = []
    for k, t, kind, i, _ in rows:
        if kind != asof.QUERY:
            continue
        points = sorted((x[1], x[4]) for x in rows if x[0] == k and x[2] == asof.SOURCE)
        before, after = [p for p in points if p[0] <= t], [p for p in points if p[0] >= t]
        b, a = before[-1] if before else None, max(p for p in after if p[0] == after[0][0]) if after else None
        if a and b:
            v = b[1] if a[0] == b[0] else b[1] + (a[1] - b[1]) * (t - b[0]) / (a[0] - b[0])
        else:
            v = (b or a or (None, None))[1] if clamp else None
        want.append((k, i, v))
    assert len(seen) == len(want)
    assert {x[:2]: x[2] for x in seen} == pytest.approx({x[:2]: x[2] for x in want})
