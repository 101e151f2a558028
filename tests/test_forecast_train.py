import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, frame
from tidecast import config
from tidecast.operators import forecast
from tidecast.plans import forecast as fplan
from tidecast.plans import train
from tidecast.sources import fixtures
from tidecast.sources.prices import fixture_prices

TIERS = {5: ("lag1", "lag5", "ma5", "ma20"), 10: ("lag5", "lag20", "ma20", "ma100"),
         30: ("lag20", "lag100", "ma100")}


def py_feature(hist, name):
    tail = hist[-100:]
    k = int(name[3:]) if name.startswith("lag") else int(name[2:])
    last = tail[-k:]
    return last[0] if name.startswith("lag") else sum(last) / len(last)


def py_forecast(hist, h, w, b):
    work = list(hist)
    out = []
    names = TIERS[5] if h <= 5 else TIERS[10] if h <= 20 else TIERS[30]
    for _ in range(h):
        p = b + sum(w[i] * py_feature(work, n) for i, n in enumerate(names))
        out.append(p)
        work.append(p)
    return out


@pytest.mark.parametrize("n_hist", [3, 12, 60, 130])
def test_array_features_clamp(spark, n_hist):
    hist = [float(100 + (i * 7) % 13) for i in range(n_hist)]
    df = spark.createDataFrame([(hist,)], "hist array<double>")
    cols = forecast.serving_feature_columns(F.col("hist"))
    r = df.select(*[c.alias(n) for n, c in cols.items()]).first()
    for n in config.FEATURE_COLUMNS:
        assert abs(r[n] - py_feature(hist, n)) < 1e-9, n


def test_recursive_forecast_matches_python_loop(spark):
    prices = fixture_prices(spark, SF001)
    req = fixtures.requests(spark, SF001)
    models = train.train_all(prices, req, fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS).models
    mh = fplan.models_with_history(models, prices, fixtures.HISTORY_DAYS, fixtures.AS_OF).toPandas()
    fc = forecast.recursive_forecast(spark.createDataFrame(mh)).toPandas()
    assert len(mh) == 30
    for _, m in mh.iterrows():
        exp = py_forecast(list(m["hist"]), int(m.forecast_days), [m.w0, m.w1, m.w2, m.w3], m.intercept)
        got = fc[(fc.ticker == m.ticker) & (fc.forecast_days == m.forecast_days)].sort_values("step")
        assert list(got.step) == list(range(1, int(m.forecast_days) + 1))
        assert np.allclose(got.predicted_price.to_numpy(), exp, rtol=1e-12)
        d = got.date.tolist()
        assert all(x.weekday() < 5 for x in d) and d[0] > m.latest_date and d == sorted(d)


def test_forecast_dates_after_friday_before_monday_holiday(spark):
    hist = [float(i) for i in range(30)]
    df = spark.createDataFrame([("A", 5, date(2021, 9, 3), hist, 0.0, 0.0, 0.0, 0.0, 1.0)],
                               "ticker string, forecast_days int, latest_date date, hist array<double>, "
                               "w0 double, w1 double, w2 double, w3 double, intercept double")
    got = forecast.recursive_forecast(df).orderBy("step").collect()
    assert [r.date for r in got] == [date(2021, 9, 7), date(2021, 9, 8), date(2021, 9, 9),
                                     date(2021, 9, 10), date(2021, 9, 13)]
    assert all(r.predicted_price == 1.0 for r in got)


def _series(ticker, n, start=date(2020, 1, 1)):
    return [(ticker, (start + timedelta(days=i)).isoformat(), float(100 + (i * 37) % 17)) for i in range(n)]


def test_run_log_codes(spark):
    # A: plenty; B: 105 rows -> 5 feature rows (INSUFFICIENT_DATA); C: 112 rows -> 12 feature rows,
    # 12 - 5 = 7 targets for h=5 (ok) and 12 - 10 = 2 for h=10 (TRAINING_FAILED)
    rows = _series("A", 200) + _series("B", 105) + _series("C", 112)
    prices = frame(spark, rows)
    req = spark.createDataFrame([("A", 5), ("B", 5), ("C", 5), ("C", 10), ("ZZZZ", 5), ("", 5), ("A", 0)],
                                "ticker string, forecast_days int")
    res = train.train_all(prices, req, "2020-12-31", now="2020-12-31 22:00:00")
    log = {(r.ticker, r.forecast_days): (r.status, r.error_code) for r in res.run_log.collect()}
    assert log[("A", 5)] == ("completed", None)
    assert log[("B", 5)] == ("failed", "INSUFFICIENT_DATA")
    assert log[("C", 5)] == ("completed", None)
    assert log[("C", 10)] == ("failed", "TRAINING_FAILED")
    assert log[("ZZZZ", 5)] == ("failed", "INSUFFICIENT_DATA")
    assert log[("", 5)] == ("failed", "INVALID_REQUEST")
    assert log[("A", 0)] == ("failed", "INVALID_REQUEST")
    m = res.models.where("ticker = 'C'").first()
    assert (m.train_samples, m.test_samples) == (6, 1)  # n = 7: floor(7/6) = 1 test row


def test_skip_when_fresh(spark):
    rows = _series("A", 200)
    prices = frame(spark, rows)
    req = spark.createDataFrame([("A", 5), ("A", 30)], "ticker string, forecast_days int")
    first = train.train_all(prices, req, "2020-12-31", now="2020-12-31 22:00:00").models
    again = train.train_all(prices, req, "2020-12-31", now="2020-12-31 23:00:00", latest_models=first)
    assert sorted((r.forecast_days, r.status) for r in again.run_log.collect()) == [(5, "skipped"), (30, "skipped")]
    assert again.models.count() == 0


def test_forecast_status_codes(spark):
    rows = _series("A", 200) + _series("B", 120)
    prices = frame(spark, rows)
    req = spark.createDataFrame([("A", 5), ("B", 5)], "ticker string, forecast_days int")
    models = train.train_all(prices, req, "2020-12-31", now="2020-12-31 22:00:00").models
    fr = fplan.forecast_all(prices, spark.createDataFrame(
        [("A", 5), ("A", 10), ("B", 5), ("Q", 5)], "ticker string, forecast_days int"), models,
        history_days=900)
    st = {(r.ticker, r.forecast_days): r.error_code for r in fr.status.collect()}
    assert st == {("A", 5): None, ("A", 10): "MODEL_NOT_FOUND", ("B", 5): None, ("Q", 5): "MODEL_NOT_FOUND"}
    # B has 20 feature rows in 900 days: fine; with 180 days A has fewer than 10 -> INSUFFICIENT_DATA
    fr2 = fplan.forecast_all(prices, req, models, history_days=10)
    assert {r.error_code for r in fr2.status.collect()} == {"INSUFFICIENT_DATA"}
    assert fr.forecasts.count() == 10


def test_training_is_invariant_to_other_series(spark):
    a = _series("A", 220)
    b = [("B", d, c * 3.0 + 1.0) for _, d, c in _series("B", 260)]
    req = spark.createDataFrame([("A", 5), ("A", 30)], "ticker string, forecast_days int")
    alone = train.train_all(frame(spark, a), req, "2020-12-31", now="2020-12-31 22:00:00").models
    mixed = train.train_all(frame(spark, a + b), req, "2020-12-31", now="2020-12-31 22:00:00").models
    cols = ["forecast_days", "w0", "w1", "w2", "w3", "intercept", "mae", "r2", "mape", "max_ae",
            "train_samples", "test_samples", "last_train_date"]
    assert sorted(alone.select(*cols).collect()) == sorted(mixed.select(*cols).collect())


def test_forecast_is_invariant_to_other_series(spark):
    a = _series("A", 220)
    b = [("B", d, c + 50.0) for _, d, c in _series("B", 240)]
    req = spark.createDataFrame([("A", 10)], "ticker string, forecast_days int")
    m = train.train_all(frame(spark, a), req, "2020-12-31", now="2020-12-31 22:00:00").models
    one = fplan.forecast_all(frame(spark, a), req, m, history_days=900).forecasts
    two = fplan.forecast_all(frame(spark, a + b), req, m, history_days=900).forecasts
    assert sorted(one.collect()) == sorted(two.collect())


def test_calendar_table_dates_equal_rule_dates(spark):
    from tidecast.operators import business_calendar
    prices = fixture_prices(spark, SF001)
    req = fixtures.requests(spark, SF001)
    models = train.train_all(prices, req, fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS).models
    mh = fplan.models_with_history(models, prices, fixtures.HISTORY_DAYS, fixtures.AS_OF)
    span = spark.createDataFrame([(date(2001, 1, 1), date(2002, 12, 31))], "start date, end date")
    cal = business_calendar.calendar_between(span)
    by_rule = forecast.recursive_forecast(mh).collect()
    by_table = forecast.recursive_forecast(mh, cal).collect()
    assert len(by_rule) == 450 and sorted(by_rule) == sorted(by_table)


def test_unlisted_horizon_is_rejected(spark):
    prices = frame(spark, _series("A", 200))
    req = spark.createDataFrame([("A", 5), ("A", 7)], "ticker string, forecast_days int")
    res = train.train_all(prices, req, "2020-12-31", now="2020-12-31 22:00:00", horizons=[5])
    log = {r.forecast_days: (r.status, r.error_code) for r in res.run_log.collect()}
    assert log == {5: ("completed", None), 7: ("failed", "HORIZON_NOT_LISTED")}


@pytest.mark.parametrize("size", [10, 99, 100])
def test_recursion_equals_a_plain_loop(spark, size):
    """Short and full histories, every tier, horizons over many chunks of the state."""
    rng = random.Random(size)
    rows, want = [], {}
    for h in (1, 5, 19, 20, 21, 41, 365):
        hist = [round(rng.uniform(50, 150), 2) for _ in range(size)]
        w = [rng.uniform(-0.2, 0.4) for _ in range(4)]
        rows.append((f"T{h}", h, date(2001, 1, 5), hist, *w, 3.0))
        names = (config.SHORT_TERM_FEATURES if h <= 5 else config.MEDIUM_TERM_FEATURES if h <= 20 else config.LONG_TERM_FEATURES)
        line = list(hist)
        for _ in range(h):
            def value(name):
                k = int(name[3:] if name.startswith("lag") else name[2:])
                return line[max(len(line) - k, 0)] if name.startswith("lag") else sum(line[-k:]) / len(line[-k:])
            line.append(3.0 + sum(c * value(n) for c, n in zip(w, names)))
        want[f"T{h}"] = line[size:]
    schema = "ticker string, forecast_days int, latest_date date, hist array<double>, w0 double, w1 double, w2 double, w3 double, intercept double"
    got = {}
    for r in forecast.recursive_forecast(spark.createDataFrame(rows, schema)).orderBy("ticker", "step").collect():
        got.setdefault(r.ticker, []).append(r.predicted_price)
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t], rel=1e-12)
