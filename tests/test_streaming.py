from datetime import date, timedelta

from tests.conftest import frame
from tidecast import schema
from tidecast.sources import registry_store as store
from tidecast.streaming import forecast_on_requests, train_on_requests


def _series(ticker, n, start=date(2020, 1, 1)):
    return [(ticker, (start + timedelta(days=i)).isoformat(), float(100 + (i * 37) % 17)) for i in range(n)]


def test_request_stream_trains_and_forecasts(spark, tmp_path):
    prices = frame(spark, _series("A", 220) + _series("B", 220))
    inbox = str(tmp_path / "inbox")
    spark.createDataFrame([("A", 5), ("B", 30)], schema.REQUESTS).write.parquet(inbox + "/1")
    stream = spark.readStream.schema(schema.REQUESTS).parquet(inbox + "/*")
    root = str(tmp_path / "registry")
    q = train_on_requests(stream, prices, root, str(tmp_path / "ck1"), as_of="2020-12-31",
                          trigger={"availableNow": True})
    q.awaitTermination(300)
    models = store.read_models(spark, root)
    assert sorted((r.ticker, r.forecast_days) for r in models.collect()) == [("A", 5), ("B", 30)]
    assert store.read_run_log(spark, root).count() == 2

    out = str(tmp_path / "fc")
    q2 = forecast_on_requests(spark.readStream.schema(schema.REQUESTS).parquet(inbox + "/*"), prices, root, out,
                              str(tmp_path / "ck2"), as_of="2020-12-31", history_days=900,
                              trigger={"availableNow": True})
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == 5 + 30


def test_replayed_training_batch_is_skipped(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    prices = frame(spark, _series("A", 220))
    req = spark.createDataFrame([("A", 5)], schema.REQUESTS)
    root = str(tmp_path / "registry")
    first = jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, 31, 22))
    again = jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, 31, 22, 1))
    assert [r.status for r in first.collect()] == ["completed"]
    assert [r.status for r in again.collect()] == ["skipped"]
    assert store.read_models(spark, root).count() == 1


def test_latest_snapshot_tracks_appends_and_deletes(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    prices = frame(spark, _series("A", 220) + _series("B", 220))
    req = spark.createDataFrame([("A", 5), ("B", 5)], schema.REQUESTS)
    root = str(tmp_path / "registry")
    jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, 30, 22))
    jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, 31, 22))
    assert store.read_snapshot(spark, root) is None  # few files: no snapshot yet
    jobs.compact(spark, root)
    snap, since = store.read_snapshot(spark, root)
    assert since is None and snap.count() == 2
    assert {r.trained_at for r in snap.collect()} == {datetime(2020, 12, 31, 22)}
    assert store.read_models(spark, root).count() == 4
    # delete A's newest version: the snapshot falls back to the older one
    dreq = spark.createDataFrame([("A", 5, "2020-12-31-17:00:00")],
                                 "ticker string, forecast_days int, last_trained_time string")
    out = jobs.run_delete(spark, dreq, root).collect()
    assert [r.status for r in out] == ["success"]
    lat = {r.ticker: r.trained_at for r in jobs.latest_models(spark, root).collect()}
    assert lat == {"A": datetime(2020, 12, 30, 22), "B": datetime(2020, 12, 31, 22)}
    full = {r.ticker: r.trained_at for r in jobs.latest_models(spark, root, use_snapshot=False).collect()}
    assert full == lat


def test_prune_snapshots_keeps_newest(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    prices = frame(spark, _series("A", 220))
    req = spark.createDataFrame([("A", 5)], schema.REQUESTS)
    root = str(tmp_path / "registry")
    for day in (28, 29, 30):
        jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, day, 22))
        jobs.compact(spark, root)
    removed = store.prune_snapshots(spark, root, keep=1)
    assert len(removed) == 2
    snap = store.read_snapshot(spark, root)[0].collect()
    assert [r.trained_at for r in snap] == [datetime(2020, 12, 30, 22)]
    assert store.read_models(spark, root).count() == 3


def test_late_snapshot_does_not_bring_a_deleted_version_back(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    prices = frame(spark, _series("A", 220))
    req = spark.createDataFrame([("A", 5)], schema.REQUESTS)
    root = str(tmp_path / "registry")
    for day in (30, 31):
        jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, day, 22))
    # a slow writer reads before the delete and writes its snapshot after it
    before = spark.createDataFrame(jobs.latest_models(spark, root).collect(), schema.MODEL)
    files = store.model_files(spark, root)
    dreq = spark.createDataFrame([("A", 5, "2020-12-31-17:00:00")],
                                 "ticker string, forecast_days int, last_trained_time string")
    jobs.run_delete(spark, dreq, root)
    store.write_snapshot(before, files, root)
    assert [r.trained_at for r in jobs.latest_models(spark, root).collect()] == [datetime(2020, 12, 30, 22)]
    # and one that missed an append hides nothing
    jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2021, 1, 4, 22))
    store.write_snapshot(before, files, root)
    assert [r.trained_at for r in jobs.latest_models(spark, root).collect()] == [datetime(2021, 1, 4, 22)]


def test_fresh_run_writes_no_model_files(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    prices = frame(spark, _series("A", 220))
    req = spark.createDataFrame([("A", 5)], schema.REQUESTS)
    root = str(tmp_path / "registry")
    for minute in (0, 1, 2):
        jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, 31, 22, minute))
        files = store.model_files(spark, root) if minute == 0 else files
    assert store.model_files(spark, root) == files


def test_corrupt_newest_version_is_reported(spark, tmp_path):
    from datetime import datetime
    from pyspark.sql import functions as F
    from tidecast.plans import forecast, jobs, train
    prices = frame(spark, _series("A", 220) + _series("B", 220))
    req = spark.createDataFrame([("A", 5), ("B", 5), ("C", 5)], schema.REQUESTS)
    root = str(tmp_path / "registry")
    jobs.run_training(spark, prices, req, root, as_of="2020-12-31", now=datetime(2020, 12, 30, 22))
    broken = store.read_models(spark, root).where("ticker = 'A'").withColumns(
        {"intercept": F.lit(None).cast("double"), "trained_at": F.lit("2020-12-31 22:00:00Z").cast("timestamp")})
    store.append_models(spark.createDataFrame(broken.collect(), schema.MODEL), root)
    res = forecast.forecast_all(prices, req, jobs.latest_models(spark, root), "2020-12-31", 900)
    assert {r.ticker: r.error_code for r in res.status.collect()} == {
        "A": "MODEL_CORRUPTED", "B": None, "C": "MODEL_NOT_FOUND"}
    assert {r.ticker for r in res.forecasts.collect()} == {"B"}
    log = train.train_all(prices, req.where("ticker = 'A'"), "2020-12-31", now="2020-12-30 22:30:00",
                          latest_models=jobs.latest_models(spark, root)).run_log.collect()
    assert [r.status for r in log] == ["completed"]  # an unusable model is stale


def test_forecast_stream_writes_statuses_and_rereads_prices(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    path, root, out = (str(tmp_path / d) for d in ("prices", "registry", "fc"))
    frame(spark, _series("A", 220)).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    req = spark.createDataFrame([("A", 5), ("NONE", 5)], schema.REQUESTS)
    jobs.run_training(spark, read(), req, root, as_of="2020-12-31", now=datetime(2020, 12, 31, 22))
    inbox = str(tmp_path / "inbox")
    req.write.parquet(inbox + "/1")
    q = forecast_on_requests(spark.readStream.schema(schema.REQUESTS).parquet(inbox + "/*"), read, root, out,
                             str(tmp_path / "ck"), as_of="2020-12-31", history_days=900, trigger={"availableNow": True})
    q.awaitTermination(300)
    status = {r.ticker: r.error_code for r in spark.read.parquet(out + "_status").collect()}
    assert status == {"A": None, "NONE": "MODEL_NOT_FOUND"}


def test_market_day():
    from datetime import datetime, timezone
    from tidecast.plans import jobs
    assert jobs.market_day(datetime(2024, 1, 6, 3, 0)) == "2024-01-05"  # 22:00 in New York
    assert jobs.market_day(datetime(2024, 7, 6, 3, 59, tzinfo=timezone.utc)) == "2024-07-05"
    assert jobs.market_day(datetime(2024, 7, 6, 4, 0)) == "2024-07-06"


def test_missing_registry_is_an_error(spark, tmp_path):
    import pytest
    from tidecast.errors import RegistryNotFound
    from tidecast.plans import jobs
    prices = frame(spark, _series("A", 20))
    req = spark.createDataFrame([("A", 5)], schema.REQUESTS)
    with pytest.raises(RegistryNotFound):
        jobs.run_forecast(spark, prices, req, str(tmp_path / "no-such"), str(tmp_path / "fc"))
