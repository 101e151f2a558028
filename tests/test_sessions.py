"""Market sessions of any calendar: staleness, next sessions, jobs."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import frame
from tidecast.functions.instants import utc_instant
from tidecast.operators import freshness, sessions
from tidecast.plans import jobs
from tidecast.sources import registry_store as store


def _days(spark, first, last, open_day, country=None):
    n = (last - first).days + 1
    rows = [(country, first + timedelta(days=i), open_day(first + timedelta(days=i))) for i in range(n)]
    df = spark.createDataFrame(rows, "country string, date date, is_business_day boolean")
    return df if country else df.drop("country")


@pytest.fixture(scope="module")
def table(spark):
    span = spark.range(1).select(F.lit("2021-01-01").cast("date").alias("start"), F.lit("2021-12-31").cast("date").alias("end"))
    other = _days(spark, date(2021, 1, 1), date(2021, 12, 31), lambda d: d.isoweekday() not in (5, 6), "XX")
    return sessions.sessions(sessions.united_states(span).unionByName(other)).cache()


def _models(spark, rows):
    from tidecast import schema
    full = [(t, 5, "LinearRegression", f"{t}-v", at, ["lag1"], {"lag1": 0.1}, 0.1, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5, 0.1, 2.0, 10, 2, date(2021, 1, 1))
            for t, at in rows]
    return spark.createDataFrame(full, schema.MODEL)


@pytest.mark.parametrize("now,trained", [
    ("2021-07-02 21:00:00", "2021-07-02 20:00:00"),  # Friday after the close
    ("2021-07-04 15:00:00", "2021-07-02 20:00:00"),  # Sunday: open in one calendar
    ("2021-07-05 21:00:00", "2021-07-02 21:00:00"),  # observed holiday in one calendar
    ("2021-07-06 12:00:00", "2021-01-05 12:00:00"),  # before the close even an old model is fresh
])
def test_built_in_rules_and_their_table_agree(spark, table, now, trained):
    req = spark.createDataFrame([("A", 5, "US"), ("B", 5, "XX"), ("C", 5, "US"), ("D", 5, "??")], "ticker string, forecast_days int, country string")
    models = _models(spark, [(t, datetime.fromisoformat(trained)) for t in "ABD"])
    got = {r.ticker: r.needs_training for r in freshness.needs_training(req, models, utc_instant(now), table).collect()}
    plain = {r.ticker: r.needs_training for r in freshness.needs_training(req.drop("country"), models, utc_instant(now)).collect()}
    assert got["A"] == plain["A"] and got["C"] and got["D"]  # no model; no such calendar
    at, made = datetime.fromisoformat(now), datetime.fromisoformat(trained)
    day = (at - timedelta(hours=4)).date()  # New York in summer

    def close(d):
        return datetime(d.year, d.month, d.day, 20, 30)
    if day.isoweekday() not in (5, 6):
        want = made < close(day) < at
    else:
        before = next(day - timedelta(days=k) for k in range(1, 8) if (day - timedelta(days=k)).isoweekday() not in (5, 6))
        want = made < close(before)
    assert got["B"] == want


def test_next_sessions_and_clock_edges(spark, table):
    rows = spark.createDataFrame([("A", "US", date(2021, 7, 2)), ("B", "XX", date(2021, 7, 2)), ("C", "US", date(2020, 12, 1))],
                                 "ticker string, country string, latest_date date")
    got = {}
    for r in sessions.next_sessions(rows, table, F.lit(3)).orderBy("ticker", "step").collect():
        got.setdefault(r.ticker, []).append(r.date)
    assert got["A"] == [date(2021, 7, d) for d in (6, 7, 8)]      # the 5th is the observed holiday
    assert got["B"] == [date(2021, 7, d) for d in (4, 5, 6)]
    assert got["C"] == [date(2021, 1, d) for d in (4, 5, 6)]      # before the calendar: from its first session on
    first = spark.createDataFrame([("US", date(2021, 1, 4))], "country string, today date")
    clock = sessions.clocks(first, table).first()
    assert clock.close_today is not None and clock.last_business_day is None and clock.close_before is None


def test_training_job_by_another_calendar(spark, tmp_path):
    prices = frame(spark, [("A", (date(2020, 6, 1) + timedelta(days=i)).isoformat(), 100.0 + i % 7) for i in range(300)])
    req = spark.createDataFrame([("A", 5)], "ticker string, forecast_days int")
    weekends_too = sessions.sessions(_days(spark, date(2021, 1, 1), date(2021, 12, 31), lambda d: True))
    root = str(tmp_path / "reg")
    jobs.run_training(spark, prices, req, root, as_of="2021-03-26", now=datetime(2021, 3, 26, 21, 0))
    saturday = datetime(2021, 3, 27, 22, 0)
    kept = jobs.run_training(spark, prices, req, root, as_of="2021-03-27", now=saturday)
    assert [r.status for r in kept.collect()] == ["skipped"]
    again = jobs.run_training(spark, prices, req, root, as_of="2021-03-27", now=saturday, market_sessions=weekends_too)
    assert [r.status for r in again.collect()] == ["completed"] and store.read_models(spark, root).count() == 2
