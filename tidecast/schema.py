"""Declared schemas, checked once at the source boundary (V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import config

PRICES = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("close", T.DoubleType(), True),
])

FEATURES = T.StructType(
    [T.StructField("ticker", T.StringType(), True),
     T.StructField("date", T.DateType(), True),
     T.StructField("price", T.DoubleType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in config.FEATURE_COLUMNS]
)

REQUESTS = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("forecast_days", T.IntegerType(), True),
])

# One row per model version; the model *is* the row (coefficients + metrics).
MODEL = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("forecast_days", T.IntegerType(), True),
    T.StructField("model_type", T.StringType(), True),
    T.StructField("version", T.StringType(), True),
    T.StructField("trained_at", T.TimestampType(), True),
    T.StructField("features", T.ArrayType(T.StringType()), True),
    T.StructField("coefficients", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("w0", T.DoubleType(), True),
    T.StructField("w1", T.DoubleType(), True),
    T.StructField("w2", T.DoubleType(), True),
    T.StructField("w3", T.DoubleType(), True),
    T.StructField("intercept", T.DoubleType(), True),
    T.StructField("mae", T.DoubleType(), True),
    T.StructField("r2", T.DoubleType(), True),
    T.StructField("mape", T.DoubleType(), True),
    T.StructField("max_ae", T.DoubleType(), True),
    T.StructField("train_samples", T.LongType(), True),
    T.StructField("test_samples", T.LongType(), True),
    T.StructField("last_train_date", T.DateType(), True),
])

# Columns a registry row must carry to be usable (V8); r2 may be null
# (fewer than two test rows), the rest may not.
MODEL_REQUIRED = ("ticker", "forecast_days", "model_type", "trained_at", "features",
                  "coefficients", "w0", "w1", "w2", "w3", "intercept", "mae", "mape",
                  "max_ae", "train_samples", "test_samples", "last_train_date")

TOMBSTONE = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("forecast_days", T.IntegerType(), True),
    T.StructField("trained_at", T.TimestampType(), True),
    T.StructField("deleted_at", T.TimestampType(), True),
])

RUN_LOG = T.StructType([
    T.StructField("run_id", T.StringType(), True),
    T.StructField("task_id", T.StringType(), True),
    T.StructField("ticker", T.StringType(), True),
    T.StructField("forecast_days", T.IntegerType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("error_code", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("version", T.StringType(), True),
    T.StructField("trained_at", T.TimestampType(), True),
    T.StructField("duration_seconds", T.DoubleType(), True),
    T.StructField("submitted_at", T.TimestampType(), True),
])

FORECAST = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("forecast_days", T.IntegerType(), True),
    T.StructField("step", T.IntegerType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("predicted_price", T.DoubleType(), True),
])


def missing_columns(df: DataFrame, required=config.REQUIRED_COLUMNS) -> list[str]:
    """V6: required columns absent from a frame (schema metadata only, no job)."""
    present = set(df.columns)
    return sorted(c for c in required if c not in present)


def require_columns(df: DataFrame, required=config.REQUIRED_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df
