"""Which (ticker, horizon) requests need a new model.

Rule (market time is New York, instants are UTC):

* no usable model, or its time is unknown -> stale;
* ``today`` (market date of ``now``) is a business day -> stale iff the model
  was trained before today's 16:30 close *and* ``now`` is past that close
  (before the close even an old model counts as fresh);
* otherwise -> stale iff trained before the 16:30 close of the last business
  day before today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import calendar, quality
from . import registry, sessions


def is_stale(trained_at: Column, now: Column) -> Column:
    today = calendar.market_date(now)
    close_today = calendar.market_close_utc(today)
    close_before = calendar.market_close_utc(calendar.last_business_day(today))
    return (F.when(trained_at.isNull(), F.lit(True))
            .when(calendar.is_business_day(today), (trained_at < close_today) & (close_today < now))
            .otherwise(trained_at < close_before))


def needs_training(requests: DataFrame, latest_models: DataFrame | None, now: Column,
                   market_sessions: DataFrame | None = None) -> DataFrame:
    """Requests ``(ticker, forecast_days)`` + ``needs_training`` and the
    latest model's ``version`` / ``trained_at`` (null when none).

    ``market_sessions`` (``sessions.sessions`` of any calendars) replaces the built-in US
    rules; requests may then name their ``country``."""
    if latest_models is None:
        return requests.withColumns({"version": F.lit(None).cast("string"),
                                     "trained_at": F.lit(None).cast("timestamp"),
                                     "needs_training": F.lit(True)})
    lm = latest_models.where(~quality.incomplete_model()).select(*registry.MODEL_KEY, "version", "trained_at")
    out = requests.join(lm, list(registry.MODEL_KEY), "left")
    if market_sessions is not None:
        dated = sessions.with_clock(out, now, market_sessions)
        return dated.withColumn("needs_training", sessions.is_stale(F.col("trained_at"), now)).select(*out.columns, "needs_training")
    return out.withColumn("needs_training", is_stale(F.col("trained_at"), now))


def skip_report(requests: DataFrame, latest_models: DataFrame, now: Column) -> DataFrame:
    """Requests that do not need training, with the stored model's metrics."""
    fresh = needs_training(requests, latest_models, now).where(~F.col("needs_training"))
    return (fresh.select(*registry.MODEL_KEY, "trained_at")
            .join(latest_models, list(registry.VERSION_KEY), "inner")
            .withColumn("status", F.lit(config.STATUS_SKIPPED)))
