from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidecast import schema
from tidecast.functions import quality, versions
from tidecast.operators import registry


def _model(ticker, h, trained, mae=1.0, intercept=2.0):
    return (ticker, h, "LinearRegression", None, trained, ["lag1", "lag5", "ma5", "ma20"],
            {"lag1": 0.1}, 0.1, 0.2, 0.3, 0.4, intercept, mae, 0.5, 0.1, 3.0, 10, 2, date(2021, 1, 1))


@pytest.fixture
def models(spark):
    rows = [_model("AAPL", 7, datetime(2023, 1, 1, 17, 0, 0)),
            _model("AAPL", 7, datetime(2023, 1, 2, 17, 0, 0), mae=2.0),
            _model("MSFT", 7, datetime(2023, 1, 2, 17, 0, 0), intercept=None)]
    df = spark.createDataFrame(rows, schema.MODEL)
    return df.withColumn("version", versions.version_string(F.col("ticker"), F.col("forecast_days"),
                                                            F.col("trained_at")))


def test_version_string_round_trip(spark):
    df = spark.createDataFrame([("AAPL", 7, datetime(2023, 1, 1, 17, 0, 0))], "t string, h int, ts timestamp")
    v = df.select(versions.version_string(F.col("t"), F.col("h"), F.col("ts")).alias("v")).first().v
    assert v == "AAPL_linear_7day_20230101120000"  # 17:00 UTC = 12:00 New York
    p = spark.createDataFrame([(v,), ("garbage",), ("X_linear_5day_20231301000000",)], "v string") \
        .select(versions.parse_version(F.col("v")).alias("p")).collect()
    assert (p[0].p.ticker, p[0].p.forecast_days, p[0].p.trained_at) == ("AAPL", 7, datetime(2023, 1, 1, 17, 0))
    assert p[1].p.ticker is None and p[2].p.trained_at is None


def _broken_datetimes():
    """From the format rule: every field too long, out of range or missing, every separator another one."""
    fields, seps = ["2024", "06", "15", "10", "20", "30"], ["-", "-", "-", ":", ":"]
    over = ["10000", "13", "31", "24", "60", "60"]  # June has 30 days

    def text(f, s):
        return f[0] + "".join(a + b for a, b in zip(s, f[1:]))
    for i in range(6):
        for wrong in (over[i], fields[i] + "0", "", "x"):
            yield text([*fields[:i], wrong, *fields[i + 1:]], seps)
    for i in range(5):
        yield text(fields, [*seps[:i], "." if seps[i] == "-" else "-", *seps[i + 1:]])
    yield text(fields, seps)[:-3]
    yield text(fields, seps) + " "


@pytest.mark.parametrize("s", list(_broken_datetimes()))
def test_bad_datetimes(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(quality.bad_datetime_string(F.col("s")).alias("b")).first().b is True


@pytest.mark.parametrize("s", ["2023-01-01-12:00:00", "2023-1-1-1:2:3"])
def test_good_datetime(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(quality.bad_datetime_string(F.col("s")).alias("b")).first().b is False


@pytest.mark.parametrize("t,bad", [("", True), (" ", True), ("\t", True), (None, True), ("A" * 11, True),
                                   ("A" * 10, False), ("AAPL", False)])
def test_ticker_rule(spark, t, bad):
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(quality.bad_ticker(F.col("t")).alias("b")).first().b is bad


def _dates():
    """From the format rule: year-month-day, one or two digits for month and day, a real day."""
    for y, m, d in ((2024, 2, 29), (2025, 12, 31), (1999, 1, 1)):
        yield f"{y}-{m:02d}-{d:02d}", False
        yield f"{y}-{m}-{d}", False
        yield f"{y}.{m:02d}-{d:02d}", True
        yield f"{y}-{m + 12}-{d:02d}", True
        yield f"{y}-{m:02d}-{d + 31}", True
        yield f"{d:02d}-{m:02d}-{y}", True
        yield f" {y}-{m:02d}-{d:02d}", True
        yield f"{y}-{m:02d}", True
    yield "2025-02-29", True


@pytest.mark.parametrize("s,bad", list(_dates()))
def test_date_rule(spark, s, bad):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(quality.bad_date_string(F.col("s")).alias("b")).first().b is bad


def test_date_range_rule(spark):
    df = spark.createDataFrame([("2023-02-01", "2023-01-01"), ("2023-01-01", "2023-01-01")], "a string, b string")
    assert [r.x for r in df.select(quality.bad_date_range(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]


@pytest.mark.parametrize("h,bad", [(0, True), (-1, True), ("7", False), ("7.5", True), (366, True),
                                   (365, False), (1, False), ("x", True)])
def test_horizon_rule(spark, h, bad):
    df = spark.createDataFrame([(str(h),)], "h string")
    assert df.select(quality.bad_horizon(F.col("h")).alias("b")).first().b is bad


def test_split_valid(spark):
    df = spark.createDataFrame([("AAPL", 5), ("", 5), ("MSFT", 0)], "ticker string, forecast_days int")
    clean, bad = quality.split_valid(df, quality.request_rules())
    assert clean.count() == 1
    assert sorted(r.violations for r in bad.collect()) == [["forecast_days"], ["ticker"]]


def test_latest_list_and_tombstones(spark, models):
    lat = registry.latest(models).collect()
    # the newest version is chosen before it is judged: MSFT's is incomplete and has no stand-in
    assert sorted((r.ticker, r.mae) for r in lat) == [("AAPL", 2.0), ("MSFT", 1.0)]
    assert [r.ticker for r in registry.latest(models).where(quality.incomplete_model()).collect()] == ["MSFT"]
    assert registry.corrupt(models).count() == 1
    tomb = spark.createDataFrame([("AAPL", 7, datetime(2023, 1, 2, 17, 0, 0), datetime(2023, 2, 1))],
                                 schema.TOMBSTONE)
    lat2 = registry.latest(models, tomb).collect()
    assert sorted((r.ticker, r.mae) for r in lat2) == [("AAPL", 1.0), ("MSFT", 1.0)]
    assert registry.count_models(models, tomb).first()["count"] == 1


def test_get_codes(spark, models):
    req = spark.createDataFrame([("AAPL", 7, "2023-01-01-12:00:00"), ("AAPL", 7, "2023-01-01-12:00:01"),
                                 ("MSFT", 7, "2023-01-02-12:00:00"), ("AAPL", 7, "2023-01-01 12:00:00")],
                                "ticker string, forecast_days int, last_trained_time string")
    got = [(r.last_trained_time, r.status, r.error_code) for r in registry.get(models, req).collect()]
    assert sorted(got) == sorted([("2023-01-01-12:00:00", "ok", None),
                                  ("2023-01-01-12:00:01", "error", "MODEL_NOT_FOUND"),
                                  ("2023-01-02-12:00:00", "error", "MODEL_CORRUPTED"),
                                  ("2023-01-01 12:00:00", "error", "INVALID_REQUEST")])


def test_delete(spark, models):
    req = spark.createDataFrame([("AAPL", 7, "2023-01-01-12:00:00"), ("AAPL", 7, "2023-01-05-12:00:00")],
                                "ticker string, forecast_days int, last_trained_time string")
    tombs, out = registry.delete(models, req, "2023-02-01 00:00:00")
    assert tombs.count() == 1
    assert sorted((r.status, r.error_code, r.version) for r in out.collect()) == [
        ("error", "MODEL_NOT_FOUND", None), ("success", None, "AAPL_linear_7day_20230101120000")]


def test_get_resolves_same_second_versions_to_newest(spark, models):
    extra = spark.createDataFrame([_model("AAPL", 7, datetime(2023, 1, 1, 17, 0, 0, 500000), mae=9.0)], schema.MODEL)
    extra = extra.withColumn("version", versions.version_string(F.col("ticker"), F.col("forecast_days"),
                                                                F.col("trained_at")))
    req = spark.createDataFrame([("AAPL", 7, "2023-01-01-12:00:00")],
                                "ticker string, forecast_days int, last_trained_time string")
    got = registry.get(models.unionByName(extra), req).collect()
    assert len(got) == 1 and got[0].mae == 9.0


def test_delete_same_second_versions_one_outcome(spark, models):
    extra = spark.createDataFrame([_model("AAPL", 7, datetime(2023, 1, 1, 17, 0, 0, 500000))], schema.MODEL)
    req = spark.createDataFrame([("AAPL", 7, "2023-01-01-12:00:00")],
                                "ticker string, forecast_days int, last_trained_time string")
    tombs, out = registry.delete(models.unionByName(extra), req, "2023-02-01 00:00:00")
    assert tombs.count() == 2
    assert [(r.status, r.version) for r in out.collect()] == [("success", "AAPL_linear_7day_20230101120000")]


def test_fall_back_hour_versions_share_one_name(spark):
    # 05:30 and 06:30 UTC on 2021-11-07 are both 01:30 in New York (EDT, then EST)
    rows = [_model("X", 5, datetime(2021, 11, 7, 5, 30), mae=1.0), _model("X", 5, datetime(2021, 11, 7, 6, 30), mae=2.0)]
    df = spark.createDataFrame(rows, schema.MODEL)
    req = spark.createDataFrame([("X", 5, "2021-11-07-01:30:00")],
                                "ticker string, forecast_days int, last_trained_time string")
    got = registry.get(df, req).collect()
    assert len(got) == 1 and got[0].mae == 2.0  # the newest save of that name, as an overwrite would leave
    tombs, _ = registry.delete(df, req, "2021-11-08 00:00:00")
    assert tombs.count() == 2
