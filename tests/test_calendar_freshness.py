from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidecast.functions import calendar
from tidecast.operators import business_calendar, freshness

# US federal weekday closures 2020-12-25 .. 2022-01-10 (observed dates included)
CLOSURES = [date(2020, 12, 25), date(2021, 1, 1), date(2021, 1, 18), date(2021, 2, 15), date(2021, 5, 31),
            date(2021, 6, 18), date(2021, 7, 5), date(2021, 9, 6), date(2021, 10, 11), date(2021, 11, 11),
            date(2021, 11, 25), date(2021, 12, 24), date(2021, 12, 31)]


def _days(spark, start, end):
    n = (end - start).days + 1
    return spark.createDataFrame([(start + timedelta(days=i),) for i in range(n)], "d date")


def test_weekday_closures(spark):
    df = _days(spark, date(2020, 12, 25), date(2022, 1, 10))
    got = sorted(r.d for r in df.where((F.weekday("d") < 5) & calendar.is_holiday(F.col("d"))).collect())
    assert got == CLOSURES


def test_business_day_flags(spark):
    df = spark.createDataFrame([(date(2022, 6, 20),), (date(2022, 6, 17),), (date(2022, 6, 19),),
                                (date(2022, 12, 26),), (date(2021, 4, 2),), (date(2023, 11, 24),)], "d date")
    got = {r.d: r.bd for r in df.select("d", calendar.is_business_day(F.col("d")).alias("bd")).collect()}
    assert got[date(2022, 6, 20)] is False   # Juneteenth on Sunday -> Monday
    assert got[date(2022, 6, 17)] is True
    assert got[date(2022, 6, 19)] is False   # weekend
    assert got[date(2022, 12, 26)] is False  # Christmas on Sunday -> Monday
    assert got[date(2021, 4, 2)] is True     # Good Friday is not a federal holiday
    assert got[date(2023, 11, 24)] is True   # day after Thanksgiving


def test_next_business_days_skip_weekend_and_monday_holiday(spark):
    df = spark.createDataFrame([(date(2021, 9, 3),)], "d date")  # Friday before Labor Day
    got = df.select(calendar.next_business_days(F.col("d"), 3).alias("n")).first().n
    assert got == [date(2021, 9, 7), date(2021, 9, 8), date(2021, 9, 9)]


def test_next_business_days_long_horizon(spark):
    df = spark.createDataFrame([(date(2021, 1, 1),)], "d date")
    got = df.select(calendar.next_business_days(F.col("d"), 365).alias("n")).first().n
    assert len(got) == 365 and len(set(got)) == 365
    assert date(2021, 12, 24) not in got and date(2021, 12, 31) not in got


def test_last_business_day(spark):
    df = spark.createDataFrame([(date(2021, 7, 6),), (date(2021, 7, 5),), (date(2022, 1, 3),)], "d date")
    got = {r.d: r.l for r in df.select("d", calendar.last_business_day(F.col("d")).alias("l")).collect()}
    assert got[date(2021, 7, 6)] == date(2021, 7, 2)
    assert got[date(2021, 7, 5)] == date(2021, 7, 2)
    assert got[date(2022, 1, 3)] == date(2021, 12, 30)


def test_calendar_table_index(spark):
    span = spark.createDataFrame([(date(2020, 12, 20), date(2022, 1, 10))], "start date, end date")
    cal = business_calendar.calendar_between(span).orderBy("date").collect()
    running = 0
    for r in cal:
        running += int(r.is_business_day)
        assert r.bd_index == running
    steps = business_calendar.next_business_days_via_calendar(
        spark.createDataFrame([("A", date(2021, 9, 3), 3)], "ticker string, latest_date date, forecast_days int"),
        business_calendar.calendar_between(span)).orderBy("step").collect()
    assert [r.date for r in steps] == [date(2021, 9, 7), date(2021, 9, 8), date(2021, 9, 9)]


def test_market_close_is_dst_aware(spark):
    df = spark.createDataFrame([(date(2021, 7, 1),), (date(2021, 12, 1),)], "d date")
    got = {r.d: r.c for r in df.select("d", calendar.market_close_utc(F.col("d")).alias("c")).collect()}
    assert got[date(2021, 7, 1)] == datetime(2021, 7, 1, 20, 30)   # EDT
    assert got[date(2021, 12, 1)] == datetime(2021, 12, 1, 21, 30)  # EST


@pytest.mark.parametrize("trained,now,stale", [
    (None, "2021-12-01 22:00:00", True),                                 # no model
    ("2021-11-30 22:00:00", "2021-12-01 20:00:00", False),               # business day, before 16:30
    ("2021-11-30 22:00:00", "2021-12-01 22:00:00", True),                # after the close, trained before it
    ("2021-12-01 21:45:00", "2021-12-01 22:00:00", False),               # trained after today's close
    ("2021-12-03 20:00:00", "2021-12-04 15:00:00", True),                # Saturday: Friday's close 21:30 UTC
    ("2021-12-03 21:40:00", "2021-12-05 15:00:00", False),               # Sunday, trained after Friday close
    ("2021-12-23 21:40:00", "2021-12-24 23:00:00", False),               # observed holiday Friday
])
def test_staleness(spark, trained, now, stale):
    df = spark.createDataFrame([(trained,)], "t string").select(F.to_timestamp("t").alias("t"))
    got = df.select(freshness.is_stale(F.col("t"), F.to_timestamp(F.lit(now))).alias("s")).first().s
    assert got is stale
