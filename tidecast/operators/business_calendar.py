"""T1 as a dimension table: one row per calendar day with its business-day
flag and a running business-day index (``bd_index``; step n after day d is
the business day with ``bd_index = bd_index(d) + n``).

The index is a running count within each year plus the total of earlier
years, so the widest window holds one year (<= 366 rows) and the
cross-year step aggregates one row per year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar


def calendar_between(span: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Calendar over the inclusive date range given by a one-row frame."""
    days = span.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("date"))
    flagged = days.select(
        "date", F.year("date").alias("year"), F.weekday("date").alias("weekday"),
        calendar.is_holiday(F.col("date")).alias("is_holiday"),
        calendar.is_business_day(F.col("date")).alias("is_business_day"))
    bd = F.col("is_business_day").cast("long")
    in_year = flagged.withColumn(
        "_in_year", F.sum(bd).over(Window.partitionBy("year").orderBy("date")
                                   .rowsBetween(Window.unboundedPreceding, 0)))
    per_year = flagged.groupBy("year").agg(F.sum(bd).alias("_total"))
    offsets = per_year.select(
        "year", (F.sum("_total").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
                 - F.col("_total")).alias("_offset"))
    return (in_year.join(offsets, "year")
            .select("date", "weekday", "is_holiday", "is_business_day",
                    (F.col("_in_year") + F.col("_offset")).alias("bd_index")))


def numbered(days: DataFrame) -> DataFrame:
    """A user's calendar ``(date, is_business_day)`` with the running ``bd_index`` (one row a day)."""
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a calendar of one country: days, not data
    return days.select("date", "is_business_day", F.sum(F.col("is_business_day").cast("long")).over(so_far).alias("bd_index"))


def calendar_for(df: DataFrame, date_col: str = "date", pad_days: int = 0) -> DataFrame:
    """Calendar spanning the dates of ``df`` (plus ``pad_days`` after)."""
    span = df.agg(F.min(date_col).alias("start"), F.date_add(F.max(date_col), pad_days).alias("end"))
    return calendar_between(span)


def next_business_days_via_calendar(df: DataFrame, cal: DataFrame, date_col: str = "latest_date",
                                    n_col: str = "forecast_days", step_col: str | None = None) -> DataFrame:
    """J4 with a (possibly user-supplied) calendar table: equi-joins on
    ``bd_index``.  Adds ``step`` (exploded 1..n, or taken from ``step_col``)
    and ``date``.  The calendar must cover the dates involved; it is a
    dimension table (one row per day), and the joins are left to AQE."""
    start = cal.select(F.col("date").alias(date_col), F.col("bd_index").alias("_start"))
    based = df.join(start, date_col, "inner")
    steps = (based.withColumn("step", F.explode(F.sequence(F.lit(1), F.col(n_col))))
             if step_col is None else based.withColumnRenamed(step_col, "step"))
    targets = cal.where("is_business_day").select(F.col("bd_index").alias("_target"), "date")
    return (steps.join(targets, steps["_start"] + steps["step"] == targets["_target"], "inner")
            .drop("_start", "_target"))
