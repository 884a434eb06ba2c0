"""The log source and the marked CSV sink: byte ranges, pushed filters, schemas, commits."""

from __future__ import annotations

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.sources import datasource


@pytest.fixture(scope="module")
def known(spark):
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def content(seed: int, last: str) -> str:
    rng = random.Random(seed)
    rows = [f"{rng.choice(['$GPGGA', '$GPRMC', '#INSPVAXA', ''])},{rng.choice(['101530.25', '235959', 'x', ''])},{'é' * rng.randint(0, 9)}" for _ in range(200)] + ["", "no comma"]
    return "\n".join(rows) + last


@pytest.mark.parametrize("last", ["", "\n", "\r\n", "\n\n"])
def test_every_line_is_read_once_however_a_file_is_cut(last):
    raw = content(1, last).encode()
    whole = [(a, b) for a, b in datasource.lines_of(io.BytesIO(raw), 0, len(raw))]
    want, at = [], 0
    for line in raw.split(b"\n"):
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    want = want[:-1] if want[-1][1] == b"" else want
    assert whole == want
    for pieces in (2, 10, 63, len(raw)):
        cuts = [len(raw) * i // pieces for i in range(pieces + 1)]
        assert [x for s, e in zip(cuts, cuts[1:], strict=False) if s < e for x in datasource.lines_of(io.BytesIO(raw), s, e)] == want


def test_files_in_ranges_and_pushed_filters(known, tmp_path):
    os.makedirs(tmp_path / "a/b")
    texts = {"a/one.ascii": content(2, "\n"), "a/b/two.txt": content(3, ""), "a/three.bin": "not read\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    df = datasource.read_logs(known, str(tmp_path), rangeBytes="500")
    assert df.rdd.getNumPartitions() >= 10
    want = sorted(x for n, t in texts.items() if not n.endswith("bin") for x in t.removesuffix("\n").split("\n"))
    assert sorted(r.value for r in df.collect()) == want
    some = df.where("kind = '$GPGGA' and seconds >= 36930 and seconds < 40000 and value like '%é%'")
    assert sorted(r.value for r in some.collect()) == [x for x in want if x.startswith("$GPGGA,101530.25") and "é" in x]
    kept = some._jdf.queryExecution().executedPlan().toString().split("Filter")
    assert len(kept) > 1 and "$GPGGA" not in kept[1].split("BatchScan")[0]  # only the filter on the text is left to Spark
    known.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    plain = datasource.read_logs(known, str(tmp_path), kinds="$GPRMC,").where("seconds >= 36930")
    known.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert sorted(r.value for r in plain.where("kind = '$GPRMC'").collect()) == [x for x in want if x.startswith(("$GPRMC,10", "$GPRMC,23"))]
    with pytest.raises(Exception, match="a log has the columns"):
        known.read.format("fieldlog").schema("value int").load(str(tmp_path)).collect()


def test_an_empty_folder_has_no_lines(known, tmp_path):
    assert known.read.format("fieldlog").load(str(tmp_path)).count() == 0


def test_clock_times():
    got = [datasource.clock_seconds(x) for x in ("101530.25", "000000", "12345", "1015300", "10153x", "", "101530.")]
    assert got == [36930.25, 0.0, None, None, None, None, 36930.0]


def test_marked_csv_commits_all_or_nothing(known, tmp_path):
    path = str(tmp_path / "out")
    df = known.range(0, 50, 1, 4).select(F.col("id").alias("größe"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit('a,"b" '), "id")).alias("text"))
    df.write.format("marked_csv").mode("append").save(path)
    parts = [p for p in os.listdir(path) if not p.startswith("_")]
    assert parts and not [p for p in os.listdir(path) if p.startswith("_")]
    assert all(open(f"{path}/{p}", "rb").read(3) == datasource.MARK for p in parts)
    back = known.read.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    assert back.columns[1] == "text" and sorted((int(r[0]), r[1]) for r in back.collect()) == sorted((r[0], r[1]) for r in df.collect())
    bad = df.select("größe", F.when(F.col("größe") == 49, F.raise_error(F.lit("stop"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("marked_csv").mode("append").save(path)
    assert sorted(p for p in os.listdir(path)) == sorted(parts)
    df.limit(3).coalesce(1).write.format("marked_csv").mode("overwrite").save(path)
    assert known.read.option("header", "true").csv(path).count() == 3
