"""Log and table scans: position sentences, inertial logs, magnetometer tables, discovery, inventory, sinks.

Parsers take a DataFrame of lines (``value``) so that they also run over tables; ``scan_*`` read files. Lines that cannot be
read drop out (permissive mode).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import gps_week_time, nmea_degrees, nmea_time, strip_crc
from ..operators import matching

# Fixed values of the formats.
GPGGA_PREFIX, GPGGA_FIELDS = "$GPGGA", 10
INSPVAX_PREFIX, INSPVAX_HEADER_FIELDS, INSPVAX_BODY_FIELDS = "#INSPVAX", 7, 22
MAG_COLUMNS = ("time_text", "mag_x", "mag_y", "mag_z", "pitch", "roll", "yaw")

#: Rows of a table that becomes JSON text.
MAX_RECORDS = 1_000_000


def parse_gpgga(lines: DataFrame, day, leap_seconds: int = 0, *keep: str) -> DataFrame:
    """Position sentences: time, lat, lon, fix_quality, satellites, hdop, alt_m. Blank quality and satellites are 0, blank hdop and altitude null."""
    fields = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.where(F.col("value").startswith(GPGGA_PREFIX)).withColumn("f", fields).where(F.size("f") >= GPGGA_FIELDS)
    at = lambda i: F.get("f", F.lit(i))
    or_zero = lambda x: F.when(x == "", F.lit(0)).otherwise(x.try_cast("int"))
    number = lambda x: F.struct(x.try_cast("double").alias("v"), (x == "").alias("blank"))
    fix = F.struct(
        nmea_time(day, at(1), leap_seconds).alias("time"), nmea_degrees(at(2), at(3)).alias("lat"), nmea_degrees(at(4), at(5)).alias("lon"),
        or_zero(at(6)).alias("fix_quality"), or_zero(at(7)).alias("satellites"), number(at(8)).alias("hdop"), number(at(9)).alias("alt_m"),
    )
    # one fix a line, made before it is looked at: a filter on columns would be pushed below and parse again
    out = rows.select(*keep, F.explode(F.array(fix)).alias("x"))
    out = out.where(" and ".join(f"x.{n} is not null" for n in ("time", "lat", "lon", "fix_quality", "satellites")) + " and " + " and ".join(f"(x.{n}.blank or x.{n}.v is not null)" for n in ("hdop", "alt_m")))
    return out.select(*keep, "x.time", "x.lat", "x.lon", "x.fix_quality", "x.satellites", F.col("x.hdop.v").alias("hdop"), F.col("x.alt_m.v").alias("alt_m"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order (the ordinal must be part of it)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(keys).orderBy(*order))).where("_r = 1").drop("_r")


def fixes(parsed: DataFrame, file: str, ordinal: str) -> DataFrame:
    """Usable fixes: quality above 0, first row of each time and file, files of more than one row."""
    rows = keep_first(parsed.where("fix_quality > 0"), [file, "time"], [ordinal])
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(file))).where("_n > 1").drop("_n")


def parse_inspvax(lines: DataFrame, *keep: str) -> DataFrame:
    """Inertial solution lines: local time, position, velocities, attitude and horizontal speed."""
    rows = lines.where(F.col("value").startswith(INSPVAX_PREFIX))
    rows = rows.withColumn("h", F.split(F.substring_index("value", ";", 1), ",")).withColumn("b", F.split(strip_crc(F.substring_index("value", ";", -1)), ","))
    rows = rows.where(F.contains("value", F.lit(";")) & (F.size("h") >= INSPVAX_HEADER_FIELDS) & (F.size("b") >= INSPVAX_BODY_FIELDS))
    num = lambda a, i: F.trim(F.get(a, F.lit(i))).try_cast("double")
    out = rows.select(
        *keep, gps_week_time(F.get("h", F.lit(5)).try_cast("int"), num("h", 6)).alias("time"), F.get("b", F.lit(0)).alias("ins_status"), F.get("b", F.lit(1)).alias("pos_type"),
        *[num("b", i).alias(n) for i, n in ((2, "lat"), (3, "lon"), (4, "height"), (6, "v_north"), (7, "v_east"), (8, "v_up"), (9, "roll"), (10, "pitch"), (11, "azimuth"))],
    )
    return out.where("time is not null and v_north is not null and v_east is not null").withColumn("horiz_speed_mps", F.hypot("v_north", "v_east"))


def union_inspvax(lines: DataFrame, file: str, tag: str, *keep: str) -> DataFrame:
    """Inertial solutions of all files whose path has ``tag`` as a part, with the file's name; a time that several files hold counts once (the first by name)."""
    inside = lines.where(F.array_contains(F.split(file, "/"), tag)).withColumn("name", F.substring_index(file, "/", -1))
    return keep_first(parse_inspvax(inside, "name", *keep), ["time"], ["name", *keep])


def parse_magnetometer(rows: DataFrame, *keep: str) -> DataFrame:
    """Magnetometer rows (MAG_COLUMNS as text): time from 17 digits yyyymmddHHMMSSmmm, numbers, total field; rows without time or a component drop out."""
    digits = F.lpad(F.regexp_replace(F.trim("time_text"), r"\.0$", ""), 17, "0")
    stamp = F.concat_ws("", F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2), F.lit(" "), F.substring(digits, 9, 2), F.lit(":"), F.substring(digits, 11, 2), F.lit(":"), F.substring(digits, 13, 2), F.lit("."), F.substring(digits, 15, 3))
    out = rows.select(*keep, stamp.try_cast("timestamp_ntz").alias("time"), *[F.col(c).try_cast("double").alias(c) for c in MAG_COLUMNS[1:]])
    out = out.where("time is not null and mag_x is not null and mag_y is not null and mag_z is not null")
    return out.withColumn("mag_total", F.sqrt(F.col("mag_x") ** 2 + F.col("mag_y") ** 2 + F.col("mag_z") ** 2))


def read_lines(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """Lines of all files under the paths, with file and the line's place in it."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(list(paths))
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))


def read_magnetometer(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all magnetometer tables under the paths, in no order: windows and joins sort what they need."""
    schema = ", ".join(f"{c} string" for c in MAG_COLUMNS)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dat").schema(schema).option("header", "true").csv(list(paths))
    return parse_magnetometer(raw.withColumn("file", F.col("_metadata.file_name")), "file")


def discover(files: DataFrame) -> DataFrame:
    """(path, size) -> one path per (name, size), the shallowest, for non-empty GPGGA text files, in no order."""
    named = files.where((F.col("size") > 0) & F.col("path").rlike(r"GPGGA[^/]*\.(ascii|txt)$"))
    named = named.withColumn("name", F.substring_index("path", "/", -1)).withColumn("depth", F.size(F.split("path", "/")))
    return keep_first(named, ["name", "size"], ["depth", "path"]).drop("depth")


def inventory(lines: DataFrame) -> DataFrame:
    """Per file: kind (the name's last part), rows, bytes, start of the first line; files of unknown kind or without a line are left out."""
    kind = F.upper(F.element_at(F.split(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", ""), "_"), -1))
    out = lines.groupBy("file").agg(F.count("*").alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.substring(F.min_by("value", "ordinal"), 1, 220).alias("head"))
    return out.withColumn("kind", kind).where("kind <> 'UNKNOWN'")


def optional_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one of the same schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV parts with a header; ``bom`` starts the header's first name with a byte order mark for spreadsheet programs."""
    first = df.columns[0]
    (df.withColumnRenamed(first, "﻿" + first) if bom else df).write.option("header", "true").option("encoding", "UTF-8").mode("overwrite").csv(path)


def records_json(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One JSON text of all rows' records (of each key's): for summary tables, whose rows are counted before they are gathered."""
    df = matching.checked(df, F.lit(1), MAX_RECORDS, "summary")
    packed = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("*"))).alias("records"))).alias("json")
    return df.groupBy(*(keys or [])).agg(packed)
