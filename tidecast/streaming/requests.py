"""S6 as a stream: ``(ticker, forecast_days)`` requests -> training / forecast jobs.

Each micro-batch runs the batch job over *all* requests in the batch at
once (one plan, no per-request loop).  Offsets live in the query's
checkpoint; a batch replayed after a failure is harmless for training,
because the staleness check reads the model files themselves and skips
versions that the first attempt appended, and forecasts and statuses are
written per epoch under ``epoch=<id>``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..plans import jobs


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)


def _read(prices: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """Prices as of now: a path-based frame lists its files once, so a long-running
    stream passes a reader, which every micro-batch calls."""
    return prices() if callable(prices) else prices


def train_on_requests(requests: DataFrame, prices: DataFrame | Callable[[], DataFrame], registry_root: str,
                      checkpoint_location: str, as_of=None, horizons=None,
                      trigger: dict | None = None) -> StreamingQuery:
    """Start a query that trains each micro-batch of requests (run log and
    models appended to the registry)."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        now = _now()
        jobs.run_training(batch.sparkSession, _read(prices), batch.select("ticker", "forecast_days"), registry_root,
                          as_of=as_of or jobs.market_day(now), now=now, horizons=horizons)

    w = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_location)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def forecast_on_requests(requests: DataFrame, prices: DataFrame | Callable[[], DataFrame], registry_root: str, out_path: str,
                         checkpoint_location: str, as_of=None,
                         history_days: int = config.FORECAST_HISTORY_DAYS,
                         trigger: dict | None = None, status_path: str | None = None) -> StreamingQuery:
    """Start a query that forecasts each micro-batch of requests with the
    latest registered models; output under ``out_path/epoch=<id>``, the status
    of every request under ``status_path/epoch=<id>`` (by default the output
    path with ``_status``)."""
    statuses = (status_path or f"{out_path.rstrip('/')}_status").rstrip("/")

    def handle(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        jobs.run_forecast(batch.sparkSession, _read(prices), batch.select("ticker", "forecast_days"), registry_root,
                          f"{out_path.rstrip('/')}/epoch={epoch_id}", as_of=as_of, history_days=history_days,
                          status_path=f"{statuses}/epoch={epoch_id}")

    w = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_location)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
