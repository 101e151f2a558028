"""Day-by-day training from moments equals a fit on the whole window."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import frame
from tidecast.operators import features, moments, ols, split
from tidecast.plans import incremental, train
from tidecast.sources.book_store import BookTables

COEFS = ["w0", "w1", "w2", "w3", "intercept"]
HORIZONS = (1, 10, 30)


def _prices(spark):
    rng = random.Random(5)
    rows = []
    for ticker, first, last, gap in (("OLD", 0, 900, 1), ("ENDS", 0, 885, 1), ("YOUNG", 700, 900, 1), ("NEW", 893, 900, 1), ("SPARSE", 0, 900, 6)):
        price = 100.0
        for d in range(first, last, gap):
            if rng.random() < 0.9:
                price = max(5.0, price + rng.gauss(0, 2))
                close = None if rng.random() < 0.01 else round(price, 2)
                rows.append((ticker, (date(2000, 1, 1) + timedelta(days=d)).isoformat(), close))
    return frame(spark, rows)


def _whole(prices, as_of, lookback):
    t = features.add_targets(features.build_features(train.training_window(prices, as_of, lookback)), HORIZONS)
    rows = split.last_fold(features.select_slots(t)).where(F.col("is_test").isNotNull())
    return ols.fit(rows.where(~F.col("is_test")))


def _check(book, prices, lookback):
    want = {(r.ticker, r.forecast_days): r for r in _whole(prices, book.as_of, lookback).collect()}
    got = {(r.ticker, r.forecast_days): r for r in incremental.models(book).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key].n == w.n
        for c in COEFS:
            assert got[key][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9), (book.as_of, key, c)
    return len(want)


def test_ten_days_equal_a_whole_fit(spark, tmp_path):
    prices, lookback = _prices(spark).cache(), 700
    day = date(2000, 1, 1) + timedelta(days=888)
    tables = BookTables(spark, str(tmp_path))
    book = incremental.start(prices, day, HORIZONS, tables, lookback_days=lookback)
    assert _check(book, prices, lookback) > 0
    for i in range(10):
        day += timedelta(days=1)
        book = incremental.advance(book, prices, day, tables, lookback_days=lookback)
        if i in (4, 9):
            _check(book, prices, lookback)
    # a repeated run replaces its rows
    again = incremental.advance(book, prices, day + timedelta(days=1), tables, lookback_days=lookback)
    again = incremental.advance(book, prices, day + timedelta(days=1), tables, lookback_days=lookback)
    assert again.rows.count() == again.rows.select("ticker", "forecast_days", "v").distinct().count()
    _check(again, prices, lookback)


def test_a_short_window_slides_past_everything(spark, tmp_path):
    prices, lookback = _prices(spark).cache(), 150
    day = date(2000, 1, 1) + timedelta(days=860)
    tables = BookTables(spark, str(tmp_path))
    book = incremental.start(prices, day, HORIZONS, tables, lookback_days=lookback)
    for days in (9, 30, 120):
        day += timedelta(days=days)
        book = incremental.advance(book, prices, day, tables, lookback_days=lookback)
        _check(book, prices, lookback)


def test_merge_and_take_out(spark):
    rng = random.Random(2)
    rows = [("A", 5, i, 1e6 + rng.random(), rng.gauss(0, 1), rng.random(), 0.0, 1e6 + rng.gauss(0, 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, forecast_days int, i int, x0 double, x1 double, x2 double, x3 double, y double").cache()

    def state(cond):
        return moments.of_rows(df.where(cond)).select("ticker", moments.as_struct().alias("m"))
    a, b, whole = state("i < 25").withColumnRenamed("m", "a"), state("i >= 25").withColumnRenamed("m", "b"), state("true").withColumnRenamed("m", "whole")
    r = a.join(b, "ticker").join(whole, "ticker").select(
        "a", "whole", moments.merged(F.col("a"), F.col("b")).alias("sum"), moments.without(F.col("whole"), F.col("b")).alias("rest"),
        moments.merged(F.col("a"), moments.nothing()).alias("same"), moments.without(F.col("a"), F.col("a")).alias("none")).first()
    for c in moments.COLUMNS:
        assert r["sum"][c] == pytest.approx(r.whole[c], rel=1e-9, abs=1e-8)
        assert r.rest[c] == pytest.approx(r.a[c], rel=1e-7, abs=1e-6)
        assert r.same[c] == r.a[c] and r.none[c] == 0


def test_history_is_numbered_once_and_stored_rows_stay_where_they_lie(spark, tmp_path, monkeypatch):
    prices, lookback = _prices(spark).cache(), 150
    day = date(2000, 1, 1) + timedelta(days=860)
    tables = BookTables(spark, str(tmp_path))
    numbered, positions = [], incremental.halo.positions
    monkeypatch.setattr(incremental.halo, "positions", lambda rows: numbered.append(rows) or positions(rows))
    book = incremental.start(prices, day, HORIZONS, tables, lookback_days=lookback)
    written = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert len(numbered) == 1 and {"numbered", "ranges"} <= written  # read back, not made again for each use
    wanted = book.state.select("ticker", "forecast_days", F.col("lo").alias("a"), F.col("hi").alias("b"))
    found = incremental._rows_in(book.rows, wanted, tables)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(r.ticker, r.forecast_days, v) for r in wanted.collect() for v in range(r.a, r.b + 1)}
    assert want and {(r.ticker, r.forecast_days, r.v) for r in found.collect()} == want
