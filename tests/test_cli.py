from tests.conftest import SF001
from tidecast import cli
from tidecast.sources import registry_store as store
from tidecast.sources.prices import fixture_prices


def test_cli_round_trip(spark, tmp_path, capsys):
    prices = str(tmp_path / "prices")
    fixture_prices(spark, SF001).write.parquet(prices)
    reg = str(tmp_path / "registry")
    base = ["--registry", reg]
    assert cli.main(["train", *base, "--prices", prices, "--as-of", "2001-12-31",
                     "--request", "S1:5", "--request", "S2:30", "--request", "ZZZZ:5"], spark) == 0
    assert store.read_models(spark, reg).count() == 2
    assert cli.main(["forecast", *base, "--prices", prices, "--as-of", "2001-12-31", "--history-days", "900",
                     "--out", str(tmp_path / "fc"), "--request", "S1:5", "--request", "S2:30"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "fc")).count() == 35
    assert cli.main(["models", *base], spark) == 0
    assert cli.main(["runs", *base], spark) == 0
    m = store.read_models(spark, reg).where("ticker = 'S1'").first()
    from datetime import timezone
    from zoneinfo import ZoneInfo
    ny = m.trained_at.replace(tzinfo=timezone.utc).astimezone(ZoneInfo("America/New_York")) \
        .strftime("%Y-%m-%d-%H:%M:%S")
    assert cli.main(["get", *base, "--request", f"S1:5:{ny}"], spark) == 0
    assert cli.main(["delete", *base, "--request", f"S1:5:{ny}"], spark) == 0
    assert store.read_tombstones(spark, reg).count() == 1
    out = capsys.readouterr().out
    assert "INSUFFICIENT_DATA" in out and "success" in out


def test_cli_prints_and_writes_every_row(spark, tmp_path, capsys):
    from datetime import date, datetime
    from tidecast import schema
    rows = [(f"T{i}", 5, "linear", f"v{i}", datetime(2024, 1, 2, 22), ["lag1"], {"lag1": 1.0}, 1.0, 0.0, 0.0, 0.0,
             1.0, 1.0, 1.0, 1.0, 1.0, 50, 10, date(2024, 1, 2)) for i in range(60)]
    reg = str(tmp_path / "registry")
    frame = spark.createDataFrame([r[:len(schema.MODEL.fields)] for r in rows], schema.MODEL)
    store.append_models(frame, reg)
    capsys.readouterr()
    assert cli.main(["models", "--registry", reg], spark) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]) == frame.where(
        "version is not null").count() == 60
    assert cli.main(["models", "--registry", reg, "--out", str(tmp_path / "m"), "--show", "3"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "m")).count() == 60


def test_run_log_ids(spark, tmp_path):
    from datetime import datetime
    from tidecast.plans import jobs
    prices = str(tmp_path / "prices")
    fixture_prices(spark, SF001).write.parquet(prices)
    from tidecast.sources import read_prices
    req = spark.createDataFrame([("S1", 5), ("S2", 5)], "ticker string, forecast_days int")
    log = jobs.run_training(spark, read_prices(spark, prices), req, str(tmp_path / "reg"), as_of="2001-12-31",
                            now=datetime(2001, 12, 31, 22)).collect()
    assert len({r.run_id for r in log}) == 1 and len({r.task_id for r in log}) == 2
    assert all(r.submitted_at == datetime(2001, 12, 31, 22) for r in log)
    assert cli.main(["runs", "--registry", str(tmp_path / "reg"), "--task-id", log[0].task_id], spark) == 0
