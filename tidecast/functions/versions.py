"""Model version strings and time-string conversions.

A version reads ``{ticker}_linear_{h}day_{yyyyMMddHHmmss}`` with the time
written in New York wall-clock time.  Internally a version is identified by
``(ticker, forecast_days, trained_at)`` with ``trained_at`` a UTC instant
(microseconds kept); the string is a rendering of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .quality import parse_datetime_text

# --- fixed values: formats -------------------------------------------------
VERSION_TIME_FORMAT = "yyyyMMddHHmmss"
API_DATETIME_FORMAT = "yyyy-MM-dd-HH:mm:ss"
VERSION_PATTERN = r"^(.+)_linear_(\d+)day_(\d{14})$"


def _local(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, config.MARKET_TIMEZONE)


def _from_local(local_ts: Column) -> Column:
    return F.to_utc_timestamp(local_ts, config.MARKET_TIMEZONE)


def version_string(ticker: Column, forecast_days: Column, trained_at: Column) -> Column:
    """T4."""
    return F.format_string(f"%s_{config.VERSION_KIND}_%dday_%s", ticker, forecast_days,
                           F.date_format(_local(trained_at), VERSION_TIME_FORMAT))


def parse_version(version: Column) -> Column:
    """T5: ``struct<ticker string, forecast_days int, trained_at timestamp>``;
    fields are null when the string does not match or the time is invalid.
    A wall-clock time in the repeated fall-back hour names two instants; the
    earlier is returned (registry look-ups compare names, so they find both)."""
    matched = version.rlike(VERSION_PATTERN)

    def part(i: int) -> Column:
        return F.when(matched, F.regexp_extract(version, VERSION_PATTERN, i))
    stamp = F.try_to_timestamp(part(3), F.lit(VERSION_TIME_FORMAT))
    return F.struct(part(1).alias("ticker"),
                    part(2).try_cast("int").alias("forecast_days"),
                    _from_local(stamp).alias("trained_at"))


def version_prefix(ticker: Column, forecast_days: Column) -> Column:
    """The name prefix every version of a key shares (``like`` pattern)."""
    return F.format_string(f"%s_{config.VERSION_KIND}_%dday_%%", ticker, forecast_days)


def parse_api_datetime(s: Column) -> Column:
    """``YYYY-MM-DD-HH:MM:SS`` (New York wall clock) -> UTC instant, null if invalid."""
    return _from_local(parse_datetime_text(s))


def api_datetime(instant: Column) -> Column:
    """UTC instant -> ``YYYY-MM-DD-HH:MM:SS`` New York wall clock."""
    return F.date_format(_local(instant), API_DATETIME_FORMAT)


def api_datetime_to_version_time(s: Column) -> Column:
    """``YYYY-MM-DD-HH:MM:SS`` -> ``YYYYMMDDHHMMSS`` (null if invalid)."""
    return F.date_format(parse_datetime_text(s), VERSION_TIME_FORMAT)
