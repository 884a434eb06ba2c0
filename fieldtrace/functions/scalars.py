"""Scalar expressions: rounding, coordinates, times, labels, likelihoods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
EARTH_RADIUS_M = 6378137.0
GPS_EPOCH = "1980-01-06 00:00:00"
GPS_LEAP_SECONDS = 18
LOCAL_OFFSET_HOURS = 8
STUDENT_NU = 3.0


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def det_round(x: Column | str, digits: int = 6) -> Column:
    """Half-up rounding by floor, the same on every engine that computes in doubles."""
    return F.floor(c(x) * float(10**digits) + 0.5) / float(10**digits)


def finite(x: Column | str) -> Column:
    """NaN and infinities as null."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def nmea_degrees(value: Column | str, hemisphere: Column | str) -> Column:
    """ddmm.mmmm text to signed degrees; empty or unreadable: null."""
    raw = c(value).try_cast("double")
    whole = F.floor(raw / 100)
    deg = whole + (raw - 100 * whole) / 60
    return F.when(c(hemisphere).isin("S", "W"), -deg).otherwise(deg)


def nmea_time(day: Column | str, hhmmss: Column | str, leap_seconds: int = 0) -> Column:
    """UTC time of day as text plus a survey day to local time, in integer microseconds, so .9999999 carries into seconds."""
    text = c(hhmmss)
    hours, minutes = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 3, 2).try_cast("int")
    micros = F.floor(F.substring(text, 5, 20).try_cast("double") * 1000000 + 0.5).cast("bigint")
    total = (hours * 3600 + minutes * 60 - leap_seconds + LOCAL_OFFSET_HOURS * 3600).cast("bigint") * 1000000 + micros
    return add_micros(F.to_timestamp_ntz(F.concat(c(day).cast("string"), F.lit(" 00:00:00"))), total)


def add_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def gps_week_time(week: Column | str, seconds: Column | str) -> Column:
    """GPS week and seconds of week to local time."""
    micros = F.floor(c(seconds) * 1000000 + 0.5).cast("bigint") + c(week).cast("bigint") * (7 * 86400 * 1000000)
    shift = (LOCAL_OFFSET_HOURS * 3600 - GPS_LEAP_SECONDS) * 1000000
    return add_micros(F.to_timestamp_ntz(F.lit(GPS_EPOCH)), micros + F.lit(shift).cast("bigint"))


def strip_crc(text: Column | str) -> Column:
    return F.substring_index(c(text), "*", 1)


def number_after(text: Column | str, prefix: str) -> Column:
    """The decimal number right after ``prefix``; an error where there is none."""
    got = F.regexp_extract(c(text), f"{prefix}([0-9.]+)", 1)
    return F.when(got == "", F.raise_error(F.concat(F.lit(f"no {prefix} in "), c(text)))).otherwise(got).cast("double")


def short_label(text: Column | str, prefix: str) -> Column:
    return F.replace(c(text), F.lit(prefix), F.lit(""))


def progress_compat(progress: Column | str, imu: Column | str, offset: float = 10.0) -> Column:
    """abs(log((p + offset) / (i + offset))); infinite where it has no finite value."""
    ratio = (c(progress) + offset) / (c(imu) + offset)
    return F.coalesce(finite(F.abs(F.log(F.when(ratio > 0, ratio)))), F.lit(float("inf")))


def gaussian_log(distance: Column | str, center, sigma, least: float = 1e-3) -> Column:
    z = (c(distance) - center) / F.greatest(F.lit(sigma) if not isinstance(sigma, Column) else sigma, F.lit(least))
    return -0.5 * z * z


def log_likelihood(obs: Column | str, expected: Column | str, sigma: float, robust: bool) -> Column:
    """Gaussian, or Student-t with STUDENT_NU degrees of freedom, up to a constant."""
    z = (c(obs) - c(expected)) / sigma
    return -0.5 * (STUDENT_NU + 1) * F.log1p(z * z / STUDENT_NU) if robust else -0.5 * z * z


def to_local_xy(lat: Column | str, lon: Column | str, lat0: Column | float, lon0: Column | float) -> tuple[Column, Column]:
    """Equirectangular east and north in metres."""
    lat0_, lon0_ = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat0, lon0))
    east = F.radians(c(lon) - lon0_) * EARTH_RADIUS_M * F.cos(F.radians(lat0_))
    return east, F.radians(c(lat) - lat0_) * EARTH_RADIUS_M


def to_lat_lon(x: Column | str, y: Column | str, lat0: Column | float, lon0: Column | float) -> tuple[Column, Column]:
    lat0_, lon0_ = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lat0, lon0))
    return lat0_ + F.degrees(c(y) / EARTH_RADIUS_M), lon0_ + F.degrees(c(x) / (EARTH_RADIUS_M * F.cos(F.radians(lat0_))))
