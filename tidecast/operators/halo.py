"""W1-W8 on series too long for one task: windows over blocks with a halo.

``series_window`` puts a whole series into one task.  Here a series is cut into blocks
of ``block_rows`` rows; a block also receives the rows just before it that its lags and
averages reach back to, and the rows just after it that its leads reach (the halo).
Every block is one window partition, so one series spreads over as many tasks as it
has blocks, and the halo rows are dropped when the block's own rows have been computed.

A row's place in its series comes from counts per span of ``bucket_days`` days, reduced
before the shuffle: the running total of earlier spans (one row per span) plus the
row's number within its own span.  No step holds a whole series in one task, and
nothing depends on how rows happen to lie in partitions, so a lost task can be run
again.  Rows must be one a ticker and day (P2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import config
from . import features

BLOCK_ROWS = 4096
BUCKET_DAYS = 1024
REACH_BACK = max(max(config.LAGS), max(config.MOVING_AVERAGES) - 1)


def positions(rows: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Adds ``pos``: the number of earlier rows of the ticker."""
    span = F.floor(F.unix_date("date") / bucket_days)
    spans = rows.groupBy("ticker", span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("ticker").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("ticker", "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("ticker", "_span").orderBy("date")
    numbered = rows.withColumn("_span", span).withColumn("_in_span", F.row_number().over(inside))
    # the rows lie by (ticker, span) already; a broadcast of them would leave the result by ticker
    return (numbered.hint("merge").join(starts, ["ticker", "_span"])
            .withColumn("pos", F.col("_start") + F.col("_in_span") - 1).drop("_span", "_in_span", "_start"))


def over_blocks(rows: DataFrame, compute: Callable[[DataFrame, WindowSpec], DataFrame], before: int = 0,
                after: int = 0, block_rows: int = BLOCK_ROWS, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``compute(rows, window)`` as over whole series, block by block.

    ``window`` partitions by ticker and block, in date order; a value may depend on up to
    ``before`` earlier and ``after`` later rows.  ``compute`` keeps the columns ``_block`` and
    ``_own``; what it returns for halo rows is dropped.  A row is copied to
    1 + ceil(before / block_rows) + ceil(after / block_rows) blocks at most."""
    own = F.floor(F.col("pos") / block_rows)
    around = F.sequence(F.greatest(own + after // -block_rows, F.lit(0)), own - before // -block_rows)
    needed = F.filter(around, lambda b: (F.col("pos") >= b * block_rows - before)
                      & (F.col("pos") < (b + 1) * block_rows + after))
    copies = (positions(rows, bucket_days).withColumn("_block", F.explode(needed))
              .withColumn("_own", F.col("_block") == own).drop("pos"))
    done = compute(copies, Window.partitionBy("ticker", "_block").orderBy("date"))
    return done.where("_own").drop("_block", "_own")


def build_features(prices: DataFrame, start=None, end=None, tickers: DataFrame | None = None,
                   warm_up: bool = True, block_rows: int = BLOCK_ROWS, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``features.build_features`` for series of any length."""
    base = features.restrict(prices, start, end, tickers)

    def compute(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return rows.select("ticker", "date", F.col("close").alias("price"), "_block", "_own",
                           *features.feature_columns(window=window))

    out = over_blocks(base.select("ticker", "date", "close"), compute, before=REACH_BACK,
                      block_rows=block_rows, bucket_days=bucket_days)
    return out.where(features.warmed_up()) if warm_up else out


def add_targets(feats: DataFrame, horizons: Iterable[int], keep_invalid: bool = False,
                block_rows: int = BLOCK_ROWS, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``features.add_targets`` for series of any length.  The halo is counted in rows of
    ``feats``, so rows that the warm-up filter dropped in mid-series do not matter."""
    hs = sorted({int(h) for h in horizons})

    def compute(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return features.add_targets(rows, hs, keep_invalid, window=window)

    return over_blocks(feats, compute, after=max(hs, default=0), block_rows=block_rows, bucket_days=bucket_days)
