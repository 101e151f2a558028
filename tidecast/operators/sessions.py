"""T1-T3, T8, J4 for any calendar: market sessions as a table.

A calendar is a table ``(country, date, is_business_day)``; without ``country`` it is the only
one.  Its sessions are its business days, numbered, each with the instant of its close.
Instants meet sessions through their market dates: the distinct dates (few, whatever the
number of requests) are matched as-of to the sessions, and the requests are joined back
on (country, date) - no join by range over the requests.  Requests of a country without
sessions, or before its first one, have no close to be measured by: they count as stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import business_calendar

ONE = ""  # the country of a calendar that names none


def sessions(days: DataFrame) -> DataFrame:
    """``(country, date, close, bd_index)``: one row a business day."""
    country = F.col("country") if "country" in days.columns else F.lit(ONE)
    open_days = days.where("is_business_day").select(country.alias("country"), "date").distinct()
    order = Window.partitionBy("country").orderBy("date")  # a calendar's days: one a date
    return open_days.select("country", "date", calendar.market_close_utc(F.col("date")).alias("close"),
                            F.row_number().over(order).cast("long").alias("bd_index"))


def united_states(span: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The built-in rules as a calendar table over a span of dates (one row)."""
    return business_calendar.calendar_between(span, start, end).select(F.lit("US").alias("country"), "date", "is_business_day")


def clocks(dates: DataFrame, table: DataFrame) -> DataFrame:
    """As-of join: market dates ``(country, today)`` -> the close of the session of that day
    (null: no session), the last session before it (T3), its close and its number."""
    marks = dates.select("country", F.col("today").alias("at"), F.lit(True).alias("asked")).distinct()
    both = table.select("country", F.col("date").alias("at"), F.struct("date", "close", "bd_index").alias("s")).join(
        marks, ["country", "at"], "full")
    earlier = Window.partitionBy("country").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("before", F.last("s", ignorenulls=True).over(earlier)).where("asked")
    return seen.select("country", F.col("at").alias("today"), F.col("s.close").alias("close_today"),
                       F.col("before.date").alias("last_business_day"), F.col("before.close").alias("close_before"),
                       F.coalesce(F.col("s.bd_index"), F.col("before.bd_index"), F.lit(0)).alias("bd_index"))


def with_clock(rows: DataFrame, now: Column, table: DataFrame) -> DataFrame:
    """Rows (``country`` optional) with ``close_today`` and ``close_before`` at ``now``."""
    if "country" not in rows.columns:
        rows = rows.withColumn("country", F.lit(ONE))
    dated = rows.withColumn("today", calendar.market_date(now))
    found = clocks(dated.select("country", "today"), table).select("country", "today", "close_today", "close_before")
    return dated.join(found, ["country", "today"], "left")


def is_stale(trained_at: Column, now: Column) -> Column:
    """T8 on rows with a clock: the rule of ``freshness.is_stale`` with the table's closes."""
    judged = (F.when(F.col("close_today").isNotNull(), (trained_at < F.col("close_today")) & (F.col("close_today") < now))
              .otherwise(trained_at < F.col("close_before")))
    return F.when(trained_at.isNull(), F.lit(True)).otherwise(F.coalesce(judged, F.lit(True)))


def next_sessions(rows: DataFrame, table: DataFrame, n: Column, date: str = "latest_date") -> DataFrame:
    """Each row once per step 1..n with the date of that session after ``date``:
    an as-of look-up of the day's number, then an equi-join on (country, number)."""
    if "country" not in rows.columns:
        rows = rows.withColumn("country", F.lit(ONE))
    at = clocks(rows.select("country", F.col(date).alias("today")), table).select("country", F.col("today").alias(date), "bd_index")
    steps = rows.join(at, ["country", date]).withColumn("step", F.explode(F.sequence(F.lit(1), n)))
    steps = steps.withColumn("bd_index", F.col("bd_index") + F.col("step"))
    return steps.join(table.select("country", "bd_index", F.col("date").alias("date")), ["country", "bd_index"]).drop("bd_index")
