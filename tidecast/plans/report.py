"""The display projection of forecasts and model metrics.

Formats (fixed values): price ``$0.00``, R^2 with 4 decimals, MAPE as a
percentage with 2 decimals, max error ``$0.00``, dates ``Mon, Jan 1, 2024``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: display formats -------------------------------------------
PRICE_FORMAT = "$%.2f"
R2_FORMAT = "%.4f"
PERCENT_FORMAT = "%.2f%%"
DATE_LABEL_FORMAT = "EEE, MMM d, yyyy"


def price_label(c: Column) -> Column:
    return F.format_string(PRICE_FORMAT, c)


def date_label(c: Column) -> Column:
    return F.date_format(c, DATE_LABEL_FORMAT)


def metrics_labels(models: DataFrame) -> DataFrame:
    """Model card: one row per model with display strings."""
    return models.select(
        "ticker", "forecast_days", "version",
        price_label(F.col("mae")).alias("mae_label"),
        F.format_string(R2_FORMAT, F.col("r2")).alias("r2_label"),
        F.format_string(PERCENT_FORMAT, F.col("mape") * 100).alias("mape_label"),
        price_label(F.col("max_ae")).alias("max_ae_label"),
        "train_samples", "test_samples")


def forecast_report(forecasts: DataFrame, models: DataFrame) -> DataFrame:
    """Forecast table rows with their model's metric labels."""
    m = models.select("ticker", "forecast_days", "r2", "mape")
    out = forecasts.join(m, ["ticker", "forecast_days"], "inner")
    return out.select(
        "ticker", F.col("forecast_days").cast("long").alias("forecast_days"),
        F.col("step").cast("long").alias("step"),
        date_label(F.col("date")).alias("date_label"),
        price_label(F.col("predicted_price")).alias("price_label"),
        F.format_string(R2_FORMAT, F.col("r2")).alias("r2_label"),
        F.format_string(PERCENT_FORMAT, F.col("mape") * 100).alias("mape_label"))
