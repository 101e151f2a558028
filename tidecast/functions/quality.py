"""V1-V5, V8, V9: validation rules as Column predicates over tables.

The service validated one argument at a time and raised; over a table each
rule is a boolean "violation" column, gathered into a ``violations`` array
so a frame can be split into clean rows and a quarantine without failing
the job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..schema import MODEL_REQUIRED


# --- fixed values: accepted text formats (strptime-style: 4-digit year,
# 1-2 digit month/day/hour/minute/second) ------------------------------------
DATE_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}$"
DATETIME_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}-\d{1,2}:\d{1,2}:\d{1,2}$"
DATE_PATTERN = "yyyy-M-d"
DATETIME_PATTERN = "yyyy-M-d-H:m:s"


def bad_ticker(t: Column) -> Column:
    """V1: null, blank (whitespace only), or longer than 10 characters."""
    return F.coalesce(t.isNull() | t.rlike(r"^\s*$") | (F.length(t) > config.MAX_TICKER_LENGTH),
                      F.lit(True))


def parse_date_text(s: Column) -> Column:
    """``YYYY-MM-DD`` (one-digit month/day accepted) -> date, null if invalid."""
    return F.when(s.rlike(DATE_TEXT), F.try_to_date(s, DATE_PATTERN))


def parse_datetime_text(s: Column) -> Column:
    """``YYYY-MM-DD-HH:MM:SS`` -> timestamp (wall clock), null if invalid."""
    return F.when(s.rlike(DATETIME_TEXT), F.try_to_timestamp(s, F.lit(DATETIME_PATTERN)))


def bad_date_string(s: Column) -> Column:
    """V2: not a ``YYYY-MM-DD`` calendar date."""
    return parse_date_text(s).isNull()


def bad_date_range(start: Column, end: Column) -> Column:
    """V3: start after end (only meaningful when both parse)."""
    return F.coalesce(parse_date_text(start) > parse_date_text(end), F.lit(False))


def bad_datetime_string(s: Column) -> Column:
    """V4: not ``YYYY-MM-DD-HH:MM:SS``."""
    return parse_datetime_text(s).isNull()


def bad_horizon(h: Column, max_horizon: int = config.MAX_HORIZON) -> Column:
    """V5: not an integer in ``1..max_horizon`` (strings and fractions rejected)."""
    as_int = h.try_cast("int")
    return F.coalesce(as_int.isNull() | (as_int.cast("double") != h.try_cast("double"))
                      | (as_int < 1) | (as_int > max_horizon), F.lit(True))


def non_finite(x: Column) -> Column:
    """V9: NaN or infinite."""
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def incomplete_model(cols: Iterable[str] = MODEL_REQUIRED) -> Column:
    """V8: a registry row missing a required field (or with a non-finite intercept)."""
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out | F.coalesce(non_finite(F.col("intercept")), F.lit(True))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, as ``array<string>`` (empty = clean)."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]),
                    lambda v: v.isNotNull())


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantine)``; the quarantine carries the ``violations`` array."""
    tagged = df.withColumn("violations", violations(rules))
    return (tagged.where(F.size("violations") == 0).drop("violations"),
            tagged.where(F.size("violations") > 0))


def request_rules(ticker: str = "ticker", forecast_days: str = "forecast_days",
                  max_horizon: int = config.MAX_HORIZON) -> dict[str, Column]:
    return {"ticker": bad_ticker(F.col(ticker)),
            "forecast_days": bad_horizon(F.col(forecast_days), max_horizon)}


def price_table_report(prices: DataFrame) -> DataFrame:
    """Per ticker: rows, extra rows on an already-seen date (the one-row-per-
    day assumption that bounds every window), non-finite closes (V9) and
    the ticker rule (V1).  One grouped aggregate: partial per task, so a hot
    ticker is counted map-side."""
    return prices.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("n_duplicate_days"),
        F.count_if(F.coalesce(non_finite(F.col("close")), F.lit(False))).alias("n_bad_close"),
        F.count_if(F.col("date").isNull()).alias("n_null_date"),
        F.max(bad_ticker(F.col("ticker"))).alias("bad_ticker"))
