"""Command line: the service's endpoints as batch jobs (``python -m tidecast``
or ``spark-submit tidecast/cli.py``).

  train     requests -> stale models trained, registry + run log appended   (POST /train)
  runs      the run log: status / result rows                               (GET /train/{id}/status|result)
  forecast  requests -> forecasts written by horizon, status shown          (POST /predict)
  models    usable versions with metrics, and their count                   (GET /models)
  get       look up versions by (ticker, horizon, YYYY-MM-DD-HH:MM:SS)      (GET /models/{t}/{h}/{time})
  delete    tombstone versions by the same key                              (DELETE /models/{t}/{h}/{time})

Requests are a table or file with ``ticker, forecast_days`` (plus
``last_trained_time`` for get/delete) or inline ``--request TICKER:H[:TIME]``.
Prices are any ``read_prices`` source.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import business_calendar, registry, sessions
from .plans import jobs
from .session import build_session
from .sources import read_prices
from .sources import registry_store as store


def _requests(spark: SparkSession, args) -> DataFrame:
    if args.requests:
        fmt = args.requests_format
        return spark.table(args.requests) if fmt == "table" else spark.read.format(fmt).option(
            "header", "true").load(args.requests)
    rows = []
    for r in args.request or []:
        parts = r.split(":", 2)
        rows.append((parts[0], int(parts[1]), parts[2] if len(parts) > 2 else None))
    return spark.createDataFrame(rows, "ticker string, forecast_days int, last_trained_time string")


def _result(df: DataFrame, args, out: str | None) -> None:
    """The whole result: to ``out`` as Parquet (with ``--show N`` rows as a
    preview), else every row as a JSON line, streamed partition by partition."""
    if out:
        df.write.mode("overwrite").parquet(out)
        df = df.sparkSession.read.parquet(out)
        if args.show:
            df.show(args.show, truncate=False)
        return
    text = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
    for row in text.toLocalIterator():
        print(row["row"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidecast", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["train", "runs", "forecast", "models", "get", "delete"])
    p.add_argument("--registry", required=True, help="registry root folder")
    p.add_argument("--prices", help="price source (path or table)")
    p.add_argument("--prices-format", default="parquet", help="parquet, csv, json, orc, table, ...")
    p.add_argument("--requests", help="request source (path or table)")
    p.add_argument("--requests-format", default="parquet")
    p.add_argument("--request", action="append", help="TICKER:HORIZON[:YYYY-MM-DD-HH:MM:SS]")
    p.add_argument("--as-of", help="data cut-off date (default: today)")
    p.add_argument("--history-days", type=int, default=config.FORECAST_HISTORY_DAYS)
    p.add_argument("--out", help="folder for the result (forecast: the forecasts)")
    p.add_argument("--status-out", help="forecast: folder for the status of every request")
    p.add_argument("--max-horizon", type=int, default=config.MAX_HORIZON, help="largest horizon a request may name")
    p.add_argument("--task-id", action="append", help="runs: only these task or run ids")
    p.add_argument("--calendar", help="Parquet table (date, is_business_day) to use instead of the built-in US business days")
    p.add_argument("--show", type=int, default=0, help="with --out: rows to preview")
    args = p.parse_args(argv)
    spark = spark or build_session()
    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)

    if args.command in ("train", "forecast"):
        if not args.prices:
            p.error("--prices is required")
        prices = read_prices(spark, args.prices, fmt=args.prices_format)
        req = _requests(spark, args).select("ticker", "forecast_days")
        market = sessions.sessions(spark.read.parquet(args.calendar)) if args.calendar else None
        if args.command == "train":
            _result(jobs.run_training(spark, prices, req, args.registry, as_of=args.as_of, now=now,
                                      max_horizon=args.max_horizon, market_sessions=market), args, args.out)
        else:
            if not args.out:
                p.error("--out is required")
            _result(jobs.run_forecast(spark, prices, req, args.registry, args.out, as_of=args.as_of,
                                      history_days=args.history_days, max_horizon=args.max_horizon,
                                      business_calendar=business_calendar.numbered(spark.read.parquet(args.calendar)) if args.calendar else None),
                    args, args.status_out)
        return 0
    store.require_root(spark, args.registry)
    if args.command == "runs":
        log = store.read_run_log(spark, args.registry)
        if args.task_id:
            log = log.where(F.col("task_id").isin(args.task_id) | F.col("run_id").isin(args.task_id))
        # the task result: status plus the metrics of the version it produced or kept
        metrics = store.read_models(spark, args.registry).select(
            *registry.VERSION_KEY, "mae", "r2", "mape", "max_ae", "train_samples", "test_samples",
            "last_train_date")
        result = log.join(metrics, list(registry.VERSION_KEY), "left")
        _result(result.orderBy(F.col("submitted_at").desc_nulls_last(), "ticker", "forecast_days"), args, args.out)
    elif args.command == "models":
        stored, tombs = store.read_models(spark, args.registry), store.read_tombstones(spark, args.registry)
        models = registry.list_models(stored, tombs)
        skipped = registry.corrupt(stored, tombs).count()
        if skipped:
            print(f"skipped {skipped} incomplete model version(s)", file=sys.stderr)
        _result(models.select("ticker", "forecast_days", "version", "mae", "r2", "mape", "max_ae", "features",
                              "coefficients", "intercept", "train_samples", "test_samples", "last_train_date"),
                args, args.out)
        print(f"{models.count()} model version(s)", file=sys.stderr)
    elif args.command == "get":
        _result(registry.get(store.read_models_of(spark, args.registry, _requests(spark, args)), _requests(spark, args),
                             store.read_tombstones(spark, args.registry)), args, args.out)
    elif args.command == "delete":
        _result(jobs.run_delete(spark, _requests(spark, args), args.registry, deleted_at=now), args, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
