"""Physical-plan properties that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tidecast.operators import features
from tidecast.operators import forecast as fc
from tidecast.plans import forecast as fplan
from tidecast.plans import train
from tidecast.sources import fixtures
from tidecast.sources.prices import fixture_prices, read_prices


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _ticker_exchanges(df) -> int:
    """Exchanges on the ticker alone that a run makes (those it reuses are not counted)."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    made = {e for e in re.findall(r"[^d]Exchange hashpartitioning\(ticker#\d+, \d+\)[^\n]*plan_id=(\d+)", plan)}
    return len(made)


@pytest.fixture(scope="module")
def price_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices") / "p")
    fixture_prices(spark, SF001).write.parquet(path)
    return path


def test_train_plan_shape(spark, price_table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plan as at scale
    try:
        p = read_prices(spark, price_table)
        res = train.train_all(p, fixtures.requests(spark, SF001), fixtures.AS_OF, now=fixtures.NOW,
                              horizons=fixtures.HORIZONS)
        plan = _plan(res.models)
        q = res.models._jdf.queryExecution().executedPlan()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        # the price scan: pushed date bounds, three columns
        formatted = res.models._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "LessThanOrEqual(date,2001-12-31)" in formatted
        assert "ReadSchema: struct<ticker:string,date:date,close:double>" in formatted
        # all windows sit in the stages after the single price exchange
        assert formatted.count("Window (") >= 4
        assert _ticker_exchanges(res.models) == 2  # prices by ticker, requested horizons by ticker (co-partitioned join)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forecast_plan_has_no_python(spark, price_table):
    p = read_prices(spark, price_table)
    models = train.train_all(p, fixtures.requests(spark, SF001), fixtures.AS_OF, now=fixtures.NOW,
                             horizons=fixtures.HORIZONS).models
    fr = fplan.forecast_all(p, fixtures.requests(spark, SF001), models, fixtures.AS_OF, fixtures.HISTORY_DAYS)
    plan = _plan(fr.forecasts)
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    assert fr.forecasts.count() == 450


def test_bucketed_prices_are_not_shuffled(spark, tmp_path):
    from tidecast.sources import write_bucketed_prices
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed_prices(fixture_prices(spark, SF001), "prices_bucketed_test", 8, path=str(tmp_path / "pb"))
        pb = read_prices(spark, "prices_bucketed_test", fmt="table")
        res = train.train_all(pb, fixtures.requests(spark, SF001), fixtures.AS_OF, now=fixtures.NOW,
                              horizons=fixtures.HORIZONS)
        formatted = res.models._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "Bucketed: true" in formatted
        # the only ticker-only exchange left is the small requested-horizons side
        assert _ticker_exchanges(res.models) == 1
        assert res.models.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS prices_bucketed_test")


def test_shuffle_partitions_for():
    from tidecast.session import shuffle_partitions_for
    assert shuffle_partitions_for(10 * 1024 ** 2, 8) == 16
    assert shuffle_partitions_for(3 * 10 ** 12, 16000) == 32000
    assert shuffle_partitions_for(100 * 1024 ** 4, 16000) == 819200


def test_serving_cuts_history_below_the_windows(spark, price_table):
    """No window runs over full history, and the oldest date any series needs bounds the scan."""
    plan = fc.serving_frame(read_prices(spark, price_table), 180, fixtures.AS_OF)._jdf.queryExecution()
    optimized = plan.optimizedPlan().toString()
    windows = [m.start() for m in re.finditer(r"Window \[", optimized)]
    cut = optimized.index("date_sub(latest_date")
    assert windows and all(w < cut for w in windows)  # a parent is printed above its child
    formatted = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date,ScalarSubquery", formatted)


def test_fan_out_equals_the_requested_pairs(spark, price_table):
    """With 40 horizons, one per ticker, a row makes one row and not forty."""
    p = read_prices(spark, price_table)
    tickers = [r.ticker for r in p.select("ticker").distinct().orderBy("ticker").limit(10).collect()]
    req = spark.createDataFrame([(t, 4 * i + k) for i, t in enumerate(tickers) for k in (1,)], "ticker string, forecast_days int")
    rows = train.split_rows(train.training_window(p, fixtures.AS_OF), range(1, 41), train.requested_horizons(req))
    optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in optimized[:optimized.index("Generate")]  # filtered before the rows fan out
    feats = features.build_features(train.training_window(p, fixtures.AS_OF), tickers=req)
    assert rows.count() == feats.count()


def test_yearly_layout_reads_the_window_only(spark, tmp_path):
    """Folders outside the look-back window are pruned, and the prices are still not shuffled."""
    from tidecast.sources import write_yearly_prices
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prices = fixture_prices(spark, SF001)
        write_yearly_prices(prices, "prices_yearly_test", 8, path=str(tmp_path / "py"))
        py = read_prices(spark, "prices_yearly_test", fmt="table")
        window = train.training_window(py, "2000-06-30")
        years = {r[0] for r in window.select(F.regexp_extract(F.input_file_name(), "year=(\\d+)", 1)).distinct().collect()}
        assert years == {"1997", "1998", "1999", "2000"}
        assert "PartitionFilters: [isnotnull(year" in _plan(window) and window.drop("year").exceptAll(
            train.training_window(prices, "2000-06-30")).isEmpty()
        res = train.train_all(py, fixtures.requests(spark, SF001), fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS)
        assert _ticker_exchanges(res.models) == 1  # the requested horizons; no price row is shuffled
        want = train.train_all(prices, fixtures.requests(spark, SF001), fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS)
        assert res.models.select("version", "train_samples").exceptAll(want.models.select("version", "train_samples")).isEmpty()
        tail = fc.history_tail(py, fixtures.HISTORY_DAYS, fixtures.AS_OF)
        assert tail.exceptAll(fc.history_tail(prices, fixtures.HISTORY_DAYS, fixtures.AS_OF)).isEmpty() and not tail.isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS prices_yearly_test")


def test_look_ups_read_their_buckets(spark, tmp_path):
    from tidecast.sources import registry_store as store
    root = str(tmp_path / "reg")
    store.append_models(fixtures.registry(spark, SF001).models, root)
    req = spark.createDataFrame([("S1", 5), ("S7", 30)], "ticker string, forecast_days int")
    found = store.read_models_of(spark, root, req)
    scan = [line for line in _plan(found).splitlines() if "PartitionFilters" in line and "bucket" in line]
    listed = re.search(r"PartitionFilters: \[(?:isnotnull\(bucket#\d+\), )?\(?bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", scan[0])
    assert listed and len((listed[1] or listed[2]).split(",")) <= 2
    want = store.read_models(spark, root).join(req, ["ticker", "forecast_days"], "left_semi").select("version")
    assert sorted(found.select("version").collect()) == sorted(want.collect()) and found.count() == 4
