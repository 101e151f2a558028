from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidecast.operators import features
from tests.conftest import frame


def _series(ticker, n, start=date(2020, 1, 1), f=lambda i: 100.0 + i):
    return [(ticker, (start + timedelta(days=i)).isoformat(), float(f(i))) for i in range(n)]


def test_lags_and_moving_averages_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(100, 5, 150), 2)
    rows = _series("A", 150, f=lambda i: vals[i])
    out = features.build_features(frame(spark, rows)).orderBy("date").toPandas()
    assert len(out) == 50  # first 100 rows are the warm-up
    for j, r in out.iterrows():
        i = 100 + j
        assert r.price == vals[i]
        assert r.lag1 == vals[i - 1] and r.lag5 == vals[i - 5]
        assert r.lag20 == vals[i - 20] and r.lag100 == vals[i - 100]
        assert abs(r.ma5 - vals[i - 4:i + 1].mean()) < 1e-9
        assert abs(r.ma20 - vals[i - 19:i + 1].mean()) < 1e-9
        assert abs(r.ma100 - vals[i - 99:i + 1].mean()) < 1e-9


def test_date_filter_sits_below_the_windows(spark):
    rows = _series("A", 300)
    df = frame(spark, rows)
    start = (date(2020, 1, 1) + timedelta(days=150)).isoformat()
    out = features.build_features(df, start=start).orderBy("date").collect()
    # lags restart inside the range: first feature row is 100 rows after the start
    assert out[0].date == date(2020, 1, 1) + timedelta(days=250)
    assert out[0].lag100 == 100.0 + 150


def test_series_are_independent(spark):
    a = _series("A", 130)
    b = _series("B", 140, f=lambda i: 50.0 - 0.1 * i)
    both = features.build_features(frame(spark, a + b)).where("ticker = 'A'").orderBy("date").collect()
    alone = features.build_features(frame(spark, a)).orderBy("date").collect()
    assert both == alone


def test_targets_drop_nulls_in_unselected_columns(spark):
    rows = _series("A", 130)
    df = features.build_features(frame(spark, rows))
    # null lag1 on one row: dropped for every horizon although the long tier does not use lag1
    df = df.withColumn("lag1", F.when(F.col("date") == date(2020, 1, 1) + timedelta(days=105),
                                      F.lit(None)).otherwise(F.col("lag1")))
    t = features.add_targets(df, [5, 30]).groupBy("forecast_days").count().orderBy("forecast_days").collect()
    # 30 feature rows: h=5 keeps 25 targets minus the null-lag1 row; h=30 keeps none
    assert [(r.forecast_days, r["count"]) for r in t] == [(5, 24)]


def test_targets_are_price_h_rows_ahead(spark):
    rows = _series("A", 140)
    t = features.add_targets(features.build_features(frame(spark, rows)), [5]).orderBy("date").collect()
    assert len(t) == 40 - 5
    assert all(r.target == r.price + 5 for r in t)


def test_slots_by_tier(spark):
    rows = _series("A", 140)
    s = features.select_slots(features.add_targets(features.build_features(frame(spark, rows)), [5, 10, 30]))
    got = {r.forecast_days: r for r in s.where(F.col("date") == date(2020, 1, 1) + timedelta(days=100)).collect()}
    f = features.build_features(frame(spark, rows)).where(
        F.col("date") == date(2020, 1, 1) + timedelta(days=100)).first()
    assert (got[5].x0, got[5].x1, got[5].x2, got[5].x3) == (f.lag1, f.lag5, f.ma5, f.ma20)
    assert (got[10].x0, got[10].x1, got[10].x2, got[10].x3) == (f.lag5, f.lag20, f.ma20, f.ma100)
    assert (got[30].x0, got[30].x1, got[30].x2, got[30].x3) == (f.lag20, f.lag100, f.ma100, 0.0)


def test_daily_close_takes_last_tick(spark):
    from datetime import datetime
    from tidecast.sources import daily_close
    ticks = spark.createDataFrame(
        [("A", datetime(2021, 1, 4, 10), 1.0), ("A", datetime(2021, 1, 4, 15), 2.0),
         ("A", datetime(2021, 1, 5, 9), 3.0)], "ticker string, ts timestamp, price double")
    got = sorted((r.date, r.close) for r in daily_close(ticks).collect())
    assert got == [(date(2021, 1, 4), 2.0), (date(2021, 1, 5), 3.0)]


def test_feature_count_by_horizon(spark):
    df = spark.createDataFrame([(h,) for h in (1, 5, 10, 20, 30)], "h int")
    got = {r.h: r.f for r in df.select("h", features.tier_features(F.col("h")).alias("f")).collect()}
    assert {h: len(f) for h, f in got.items()} == {1: 4, 5: 4, 10: 4, 20: 4, 30: 3}
    assert "lag1" in got[5] and "ma5" in got[5]
    assert "lag5" in got[10] and "ma20" in got[20]
    assert "lag20" in got[30] and "ma100" in got[30]


def test_read_prices_from_csv_and_timestamps(spark, tmp_path):
    from datetime import datetime
    from tidecast.sources import read_prices
    raw = spark.createDataFrame([("A", datetime(2021, 1, 4, 16, 0), 10.5), ("A", datetime(2021, 1, 5, 16, 0), 11.0)],
                                "symbol string, ts timestamp, px double")
    raw.write.option("header", "true").csv(str(tmp_path / "csv"))
    df = read_prices(spark, str(tmp_path / "csv"), fmt="csv", options={"header": "true"},
                     ticker="symbol", date="ts", close="px")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "date", "double"]
    assert sorted((r.date, r.close) for r in df.collect()) == [(date(2021, 1, 4), 10.5), (date(2021, 1, 5), 11.0)]


def test_unreadable_source_is_data_fetch_failed(spark, tmp_path):
    import pytest
    from tidecast.errors import DataFetchError
    from tidecast.sources import read_prices
    with pytest.raises(DataFetchError) as e:
        read_prices(spark, str(tmp_path / "missing"))
    assert e.value.code == "DATA_FETCH_FAILED"
