"""Batch jobs with their sinks: train (B1 + S2 + S6), forecast (B2 + S5),
delete (S4).  Each job reads the registry once, runs one plan, and writes
append-only Parquet.  Lineage is cut with a reliable checkpoint into the
session's shared ``spark.checkpoint.dir`` (never a local checkpoint), so a
lost executor costs a recomputation of at most one stage.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.instants import ensure_utc, utc_instant
from ..operators import registry
from ..session import cut_lineage
from ..sources import registry_store as store
from .forecast import forecast_all
from .train import train_all


def market_day(now: datetime) -> str:
    """The market's calendar date at an instant (naive: UTC)."""
    instant = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    return instant.astimezone(ZoneInfo(config.MARKET_TIMEZONE)).date().isoformat()


def latest_models(spark: SparkSession, root: str, use_snapshot: bool = True) -> DataFrame:
    """Newest live version per key (it may be incomplete, see
    ``registry.latest``).

    A snapshot is a cache over the files it lists: versions in files written
    since are read beside it, and deletions are applied now, whenever either
    was written.  A key whose snapshot row has been deleted is looked up in
    the whole history."""
    models, tombs = store.read_models(spark, root), store.read_tombstones(spark, root)
    found = store.read_snapshot(spark, root) if use_snapshot else None
    if found is None:
        return registry.latest(models, tombs)
    snap, since = found
    known = snap if since is None else snap.unionByName(since)
    deleted = cut_lineage(snap.join(tombs, list(registry.VERSION_KEY), "left_semi").select(*registry.MODEL_KEY))
    if not deleted.isEmpty():
        older = store.read_models_of(spark, root, deleted)
        known = known.unionByName(older)
    return registry.latest(known, tombs)


def compact(spark: SparkSession, root: str) -> str:
    """Writes a new snapshot of the newest live versions (maintenance; jobs
    call it once ``config.FILES_BEFORE_SNAPSHOT`` files are not covered)."""
    files = store.model_files(spark, root)  # listed first: what comes later is read beside the snapshot
    return store.write_snapshot(latest_models(spark, root), files, root)


def run_training(spark: SparkSession, prices: DataFrame, requests: DataFrame, registry_root: str,
                 as_of=None, now: datetime | None = None, horizons=None,
                 test_size: float = config.DEFAULT_TEST_SIZE, max_horizon: int = config.MAX_HORIZON,
                 market_sessions: DataFrame | None = None) -> DataFrame:
    """Train stale requests, append new versions and one run-log row per
    request (with the job's duration).  Returns the run log as written.

    ``as_of``: the data cut-off, by default the market date of ``now``."""
    ensure_utc(spark)
    started = time.time()
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    as_of = as_of or market_day(now)
    current = latest_models(spark, registry_root)
    res = train_all(prices, requests, as_of, now=now, latest_models=current, horizons=horizons,
                    test_size=test_size, materialize=cut_lineage, max_horizon=max_horizon, market_sessions=market_sessions)
    if not res.models.isEmpty():  # nothing trained: no files
        store.append_models(res.models, registry_root)
        if store.uncovered_files(spark, registry_root) >= config.FILES_BEFORE_SNAPSHOT:
            compact(spark, registry_root)
    # the run log reads the checkpointed outcomes: writing it does not retrain.
    # run_id names the job; task_id (one per request) is derived from it.
    run_id = str(uuid.uuid4())
    log = res.run_log.withColumns({
        "run_id": F.lit(run_id),
        "task_id": F.sha2(F.concat_ws("|", F.lit(run_id), F.col("ticker"),
                                      F.col("forecast_days").cast("string")), 256).substr(1, 32),
        "duration_seconds": F.lit(time.time() - started),
        "submitted_at": utc_instant(now),
    })
    store.append_run_log(log, registry_root)
    return log


def run_forecast(spark: SparkSession, prices: DataFrame, requests: DataFrame, registry_root: str,
                 out_path: str, as_of=None,
                 history_days: int = config.FORECAST_HISTORY_DAYS, status_path: str | None = None,
                 business_calendar: DataFrame | None = None, max_horizon: int = config.MAX_HORIZON) -> DataFrame:
    """Forecast every request with its latest model; writes forecasts
    partitioned by horizon (and the per-request status, if a path is given)
    and returns the status."""
    ensure_utc(spark)
    store.require_root(spark, registry_root)
    res = forecast_all(prices, requests, cut_lineage(latest_models(spark, registry_root)), as_of, history_days,
                       materialize=cut_lineage, business_calendar=business_calendar, max_horizon=max_horizon)
    store.write_forecasts(res.forecasts, out_path)
    if status_path:
        res.status.write.mode("overwrite").parquet(status_path)
    return res.status


def run_delete(spark: SparkSession, requests: DataFrame, registry_root: str,
               deleted_at: datetime | None = None) -> DataFrame:
    """Delete versions ``(ticker, forecast_days, last_trained_time)``;
    appends tombstones and returns the per-request outcome."""
    ensure_utc(spark)
    store.require_root(spark, registry_root)
    deleted_at = deleted_at or datetime.now(timezone.utc).replace(tzinfo=None)
    models, tombs = store.read_models_of(spark, registry_root, requests), store.read_tombstones(spark, registry_root)
    new_tombs, outcome = registry.delete(models, requests, deleted_at, tombs)
    outcome = cut_lineage(outcome)
    store.append_tombstones(new_tombs, registry_root)  # readers apply them to any snapshot
    return outcome
