"""Forecast every request in one plan.

requests -(left, keys)-> latest models -(inner, ticker)-> serving history
-> array recursion -> posexplode.  The joins are on key tables (one row
per request / model / ticker); the only pass over price rows is the
serving window, shuffled once by ticker.  Join strategy is left to AQE,
which broadcasts a side only when its measured size is under the
threshold.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config, outcomes
from ..functions import quality
from ..operators import forecast as fc

KEYS = ("ticker", "forecast_days")

ForecastResult = namedtuple("ForecastResult", ["forecasts", "status"])


def models_with_history(latest_models: DataFrame, prices: DataFrame,
                        history_days: int = config.FORECAST_HISTORY_DAYS, as_of=None,
                        requests: DataFrame | None = None) -> DataFrame:
    """Each model with its series' serving history."""
    m = latest_models.select(*KEYS, "version", *[f"w{i}" for i in range(config.N_SLOTS)], "intercept")
    if requests is not None:
        m = m.join(requests.select(*KEYS).distinct(), list(KEYS), "left_semi")
        prices = prices.join(requests.select("ticker").distinct(), "ticker", "left_semi")
    hist = fc.history_arrays(prices, history_days, as_of)
    return m.join(hist, "ticker", "inner")


def forecast_all(prices: DataFrame, requests: DataFrame, latest_models: DataFrame,
                 as_of=None, history_days: int = config.FORECAST_HISTORY_DAYS,
                 materialize=None, business_calendar: DataFrame | None = None,
                 max_horizon: int = config.MAX_HORIZON) -> ForecastResult:
    """B2: ``forecasts`` (ticker, forecast_days, step, date, predicted_price)
    and ``status`` (one row per request: ok / error with a code).

    Error codes: INVALID_REQUEST (V1/V5), MODEL_NOT_FOUND (J2: no stored
    model), MODEL_CORRUPTED (the newest stored model is incomplete; no older
    one is taken instead), INSUFFICIENT_DATA (no data, or fewer than 10
    feature rows in the serving window).  ``materialize`` (e.g. a reliable checkpoint) is
    applied to the per-model serving state, which both outputs read.
    ``business_calendar`` replaces the built-in US business-day rules.
    """
    req = requests.select("ticker", "forecast_days")
    clean, rejected = quality.split_valid(req, quality.request_rules(max_horizon=max_horizon))
    clean = clean.select("ticker", F.col("forecast_days").cast("int").alias("forecast_days")).distinct()
    newest = latest_models.select(*KEYS, "version", quality.incomplete_model().alias("unusable"))
    joined = models_with_history(latest_models.where(~quality.incomplete_model()), prices, history_days, as_of, clean)
    if materialize is not None:
        joined = materialize(joined)
    with_model = clean.join(newest, list(KEYS), "left")
    counts = joined.select(*KEYS, "n_hist", "n_dup")
    n_hist = F.coalesce(F.col("n_hist"), F.lit(0))
    message = (F.when(F.col("error_code") == config.MODEL_NOT_FOUND,
                      outcomes.no_model(F.col("ticker"), F.col("forecast_days")))
               .when(F.col("error_code") == config.MODEL_CORRUPTED, outcomes.unusable_model(F.col("version")))
               .when(F.col("error_code") == config.DUPLICATE_DAYS, outcomes.several_rows_a_day(F.col("n_dup")))
               .when(F.col("error_code") == config.INSUFFICIENT_DATA, outcomes.too_short(F.col("ticker"), n_hist)))
    status = (with_model.join(counts, list(KEYS), "left")
              .withColumn("error_code", F.when(F.col("unusable").isNull(), F.lit(config.MODEL_NOT_FOUND))
                          .when(F.col("unusable"), F.lit(config.MODEL_CORRUPTED))
                          .when(F.col("n_dup") > 0, F.lit(config.DUPLICATE_DAYS))
                          .when(n_hist < config.MIN_FEATURE_ROWS, F.lit(config.INSUFFICIENT_DATA))))
    status = status.select(*KEYS, "version",
                           F.when(F.col("error_code").isNull(), F.lit("ok"))
                           .otherwise(F.lit("error")).alias("status"), "error_code",
                           message.alias("error"))
    status = status.unionByName(rejected.select(
        "ticker", F.col("forecast_days").try_cast("int").alias("forecast_days"),
        F.lit(None).cast("string").alias("version"), F.lit("error").alias("status"),
        F.lit(config.INVALID_REQUEST).alias("error_code"),
        outcomes.invalid(F.col("violations")).alias("error")))
    usable = joined.where((F.col("n_hist") >= config.MIN_FEATURE_ROWS) & (F.col("n_dup") == 0))
    return ForecastResult(fc.recursive_forecast(usable, business_calendar), status)


def predict_named(prices: DataFrame, models: DataFrame, requests: DataFrame,
                  history_days: int = config.FORECAST_HISTORY_DAYS, as_of=None) -> DataFrame:
    """R2 for a request table ``(ticker, version, date)``: one row per request, with the
    prediction of the named model version and the given date echoed.

    ``status`` is ok or error; ``error_code`` is MODEL_NOT_FOUND (no such version is stored),
    MODEL_CORRUPTED (it is incomplete), DUPLICATE_DAYS or INSUFFICIENT_DATA (no serving history,
    or fewer than 10 feature rows); a request in error has no prediction."""
    stored = models.withColumn("_unusable", quality.incomplete_model()).dropDuplicates(["ticker", "version"])
    named = requests.select("ticker", "version", "date").join(stored, ["ticker", "version"], "left")
    hist = fc.history_arrays(prices.join(requests.select("ticker").distinct(), "ticker", "left_semi"), history_days, as_of)
    code = (F.when(F.col("_unusable").isNull(), F.lit(config.MODEL_NOT_FOUND))
            .when(F.col("_unusable"), F.lit(config.MODEL_CORRUPTED))
            .when(F.col("n_dup") > 0, F.lit(config.DUPLICATE_DAYS))
            .when(F.coalesce(F.col("n_hist"), F.lit(0)) < config.MIN_FEATURE_ROWS, F.lit(config.INSUFFICIENT_DATA)))
    judged = named.join(hist, "ticker", "left").withColumn("error_code", code)
    usable = judged.where(F.col("error_code").isNull())
    good = fc.single_prediction(usable, date="date").withColumns({"status": F.lit("ok"), "error_code": F.lit(None).cast("string")})
    bad = judged.where(F.col("error_code").isNotNull()).select(
        "ticker", "forecast_days", "version", "date", F.lit(None).cast("double").alias("predicted_price"),
        F.lit(None).cast("array<string>").alias("features_used"), F.lit("error").alias("status"), "error_code")
    return good.unionByName(bad)


def history_plus_forecast(history_tail: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The serving history and the forecast of each key in one frame
    (``kind`` = history / forecast)."""
    h = history_tail.select("ticker", "date", F.col("price").alias("price"),
                            F.lit("history").alias("kind"))
    f = forecasts.select("ticker", "forecast_days", "step", "date",
                         F.col("predicted_price").alias("price"), F.lit("forecast").alias("kind"))
    return h.unionByName(f, allowMissingColumns=True)
