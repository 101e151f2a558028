"""The model registry as tables.

A model version is a row of ``schema.MODEL`` keyed by
``(ticker, forecast_days, trained_at)``.  Deletion appends a tombstone row;
readers drop tombstoned versions with a ``left_anti`` join.  Listing never
deserialises anything: metadata are columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import quality, versions
from ..functions.instants import utc_instant

VERSION_KEY = ("ticker", "forecast_days", "trained_at")
MODEL_KEY = ("ticker", "forecast_days")


def live(models: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Versions not deleted."""
    if tombstones is None:
        return models
    return models.join(tombstones.select(*VERSION_KEY), list(VERSION_KEY), "left_anti")


def list_models(models: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """S3 + V8: usable versions; incomplete rows are left out (see ``corrupt``)."""
    return live(models, tombstones).where(~quality.incomplete_model())


def corrupt(models: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Rows a listing skips (the service logged and skipped them)."""
    return live(models, tombstones).where(quality.incomplete_model())


def count_models(models: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """A11."""
    return list_models(models, tombstones).agg(F.count(F.lit(1)).alias("count"))


def latest(models: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """A10: newest live version per (ticker, forecast_days), by ``trained_at``.

    The newest version is chosen first and judged afterwards: if it is
    incomplete (``quality.incomplete_model``) the key has no usable model, and
    no older version stands in for it.  The newest instant per key is a hash
    aggregate reduced before the shuffle; the rows are then picked by a semi
    join; of several rows of one version (a replayed append) one stays.
    """
    kept = live(models, tombstones)
    newest = kept.groupBy(*MODEL_KEY).agg(F.max("trained_at").alias("trained_at"))
    rows = kept.join(newest, list(VERSION_KEY), "left_semi")
    return rows.dropDuplicates(list(VERSION_KEY)).select(*models.columns)


def _lookups(requests: DataFrame) -> DataFrame:
    """Requests ``(ticker, forecast_days, last_trained_time 'YYYY-MM-DD-HH:MM:SS')``
    -> version key, with rule violations (V1, V4, V5)."""
    return requests.select(
        "ticker", "forecast_days", "last_trained_time",
        # canonical New York wall-clock second the request names
        F.date_format(quality.parse_datetime_text(F.col("last_trained_time")),
                      versions.API_DATETIME_FORMAT).alias("_wall"),
        quality.violations({
            "ticker": quality.bad_ticker(F.col("ticker")),
            "forecast_days": quality.bad_horizon(F.col("forecast_days")),
            "last_trained_time": quality.bad_datetime_string(F.col("last_trained_time")),
        }).alias("violations"))


def _instant(v):
    """A Column, a ``datetime`` or a ``'yyyy-MM-dd HH:mm:ss'`` UTC string."""
    return utc_instant(v)


def _wall(ts):
    """A version's New York wall-clock second, the way its name addressed it
    (both instants of the repeated fall-back hour share one)."""
    return versions.api_datetime(ts)


def get(models: DataFrame, requests: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Point look-ups by (ticker, horizon, New York wall-clock second).

    Every request yields one row: ``status`` ``ok`` with the model, or
    ``error_code`` ``INVALID_REQUEST`` / ``MODEL_NOT_FOUND`` /
    ``MODEL_CORRUPTED`` (the version exists but is incomplete).
    """
    look = _lookups(requests)
    cand = live(models, tombstones).withColumns({
        "_sec": _wall(F.col("trained_at")),
        "_corrupt": quality.incomplete_model()})
    joined = look.alias("r").join(
        cand.alias("m"),
        (F.col("r.ticker") == F.col("m.ticker")) & (F.col("r.forecast_days") == F.col("m.forecast_days"))
        & (F.col("r._wall") == F.col("m._sec")) & (F.size(F.col("r.violations")) == 0),
        "left")
    code = (F.when(F.size(F.col("r.violations")) > 0, F.lit(config.INVALID_REQUEST))
            .when(F.col("m.ticker").isNull(), F.lit(config.MODEL_NOT_FOUND))
            .when(F.col("m._corrupt"), F.lit(config.MODEL_CORRUPTED)))
    model_cols = [c for c in cand.columns if c not in ("ticker", "forecast_days", "_sec", "_corrupt")]
    out = joined.select(
        F.col("r.ticker").alias("ticker"), F.col("r.forecast_days").alias("forecast_days"),
        F.col("r.last_trained_time").alias("last_trained_time"),
        F.when(code.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        code.alias("error_code"),
        *[F.when(code.isNull(), F.col(f"m.{c}")).alias(c) for c in model_cols])
    # versions are addressed to the second: several saves in one second
    # resolve to the newest, one row per look-up
    keys = ["ticker", "forecast_days", "last_trained_time"]
    rest = [c for c in out.columns if c not in keys]
    return (out.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.coalesce(F.col("trained_at"), F.lit(0).cast("timestamp")))
                 .alias("_r"))
            .select(*keys, "_r.*"))


def delete(models: DataFrame, requests: DataFrame, deleted_at,
           tombstones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(tombstones_to_append, outcome_rows)``.

    Deleting a version that does not exist (or is already deleted) is
    ``MODEL_NOT_FOUND``; a found version yields a tombstone with the exact
    stored ``trained_at`` and outcome ``success`` with its version string.
    """
    look = _lookups(requests)
    cand = live(models, tombstones).select(
        F.col("ticker").alias("_t"), F.col("forecast_days").alias("_h"),
        F.col("trained_at").alias("_stored"), _wall(F.col("trained_at")).alias("_sec"))
    joined = look.join(
        cand,
        (look.ticker == cand._t) & (look.forecast_days == cand._h)
        & (look._wall == cand._sec) & (F.size(look.violations) == 0),
        "left")
    code = (F.when(F.size("violations") > 0, F.lit(config.INVALID_REQUEST))
            .when(F.col("_stored").isNull(), F.lit(config.MODEL_NOT_FOUND)))
    ts = _instant(deleted_at)
    # every version saved within the addressed second is tombstoned; the
    # request still gets one outcome row
    outcome = joined.select(
        "ticker", "forecast_days", "last_trained_time",
        F.when(code.isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
        code.alias("error_code"),
        F.when(code.isNull(), versions.version_string(F.col("ticker"), F.col("forecast_days"),
                                                      F.col("_stored"))).alias("version")).distinct()
    new_tombs = joined.where(code.isNull()).select(
        "ticker", "forecast_days", F.col("_stored").alias("trained_at"),
        ts.alias("deleted_at"))
    return new_tombs, outcome
