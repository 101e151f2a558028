"""Held-out metrics and sample counts, as one grouped aggregate.

Definitions follow the usual regression metrics:
MAE = mean |y - yhat|; R^2 = 1 - SSE/SST out of sample (may be negative;
SST = 0 gives 1.0 when SSE = 0 else 0.0; fewer than two test rows gives
null); MAPE = mean |y - yhat| / max(|y|, eps) as a fraction; max error =
max |y - yhat|.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

KEYS = ("ticker", "forecast_days")


def metric_aggregates(y: Column, yhat: Column, test: Column) -> list[Column]:
    err = F.when(test, F.abs(y - yhat))
    yt = F.when(test, y)
    sse = F.sum(F.when(test, (y - yhat) * (y - yhat)))
    n_test = F.count_if(test)
    sst = F.var_pop(yt) * n_test
    r2 = (F.when(n_test < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - sse / sst))
    return [
        F.avg(err).alias("mae"),
        r2.alias("r2"),
        F.avg(err / F.greatest(F.abs(yt), F.lit(config.MAPE_EPSILON))).alias("mape"),
        F.max(err).alias("max_ae"),
        F.count_if(~test).cast("long").alias("train_samples"),
        n_test.cast("long").alias("test_samples"),
    ]


def evaluate(scored: DataFrame, keys=KEYS) -> DataFrame:
    """Rows ``keys, date, y, yhat, is_test`` -> one metrics row per key,
    plus ``last_train_date`` = last date of all rows, test rows included (A9)."""
    return scored.groupBy(*keys).agg(
        *metric_aggregates(F.col("y"), F.col("yhat"), F.col("is_test")),
        F.max("date").alias("last_train_date"))
