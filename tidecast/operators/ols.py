"""Ordinary least squares with intercept, one model per key.

The fit needs only centred second moments of the training rows, which are
algebraic aggregates (partial + final merge), so a key of any size is
reduced without holding its rows, and the elimination runs on one row a key.
Held-out rows meet their model through ``packed``: one row a ticker with all its
models, joined on the ticker alone, which is how the rows are partitioned already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import linalg

KEYS = ("ticker", "forecast_days")
P = config.N_SLOTS


def _moment_exprs() -> dict[str, Column]:
    xs = [F.col(f"x{i}") for i in range(P)]
    y = F.col("y")
    out: dict[str, Column] = {}
    for i in range(P):
        for j in range(i, P):
            out[f"c{i}{j}"] = F.covar_pop(xs[i], xs[j])
    for i in range(P):
        out[f"b{i}"] = F.covar_pop(xs[i], y)
    for i in range(P):
        out[f"m{i}"] = F.avg(xs[i])
    out["my"] = F.avg(y)
    return out


def moments(training_rows: DataFrame, keys=KEYS) -> DataFrame:
    """A3 sufficient statistics per key (rows given are the training rows)."""
    return training_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in _moment_exprs().items()])


def solve(df: DataFrame) -> DataFrame:
    """Adds ``w0..w3`` and ``intercept`` from the moment columns; one
    projection per elimination stage, intermediates dropped."""
    for stage in linalg.solve_stages(P):
        df = df.withColumns({name: F.expr(sql) for name, sql in stage})
    return df.drop(*linalg.temp_columns(P))


def fit(training_rows: DataFrame, keys=KEYS) -> DataFrame:
    """One model row per key: ``keys, n, w0..w3, intercept``."""
    return solve(moments(training_rows, keys)).drop(*linalg.moment_names(P))


def packed(models: DataFrame) -> DataFrame:
    """``(ticker, models map<forecast_days, struct>)``: at most ``MAX_HORIZON`` models a ticker."""
    names = [*[f"w{i}" for i in range(P)], "intercept"]
    entry = F.struct("forecast_days", F.struct(*names))
    return models.groupBy("ticker").agg(F.map_from_entries(F.collect_list(entry)).alias("models"))


def with_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of (ticker, forecast_days, ...) with their key's ``w0..w3, intercept`` (null without a model)."""
    found = rows.join(packed(models), "ticker", "left").withColumn("_m", F.col("models")[F.col("forecast_days")])
    return found.select(*rows.columns, "_m.*")


def predict(df: DataFrame, out: str = "yhat") -> DataFrame:
    """``intercept + sum w_i x_i``."""
    return df.withColumn(out, F.expr(linalg.prediction_sql(P)))
