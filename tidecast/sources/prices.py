"""The daily price table ``(ticker string, date date, close double)``.

Any connector works as long as it yields that shape; the reader only
projects and casts, so Catalyst pushes the caller's ticker/date filters and
the three-column projection down into the scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataFetchError
from ..schema import require_columns

YEAR = "year"  # the folder column of ``write_yearly_prices``


def normalize_prices(df: DataFrame, ticker: str = "ticker", date: str = "date",
                     close: str = "close") -> DataFrame:
    """Project the three columns; ``DATE(date)`` accepts a date or a timestamp.  A
    source laid out by year (``write_yearly_prices``) keeps the column that prunes it."""
    require_columns(df, (ticker, date, close))
    return df.select(
        F.col(ticker).cast("string").alias("ticker"),
        F.to_date(F.col(date)).alias("date"),
        F.col(close).cast("double").alias("close"),
        *[F.col(c) for c in df.columns if c == YEAR],
    )


def in_range(prices: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """``start <= date <= end``; in a source laid out by year also by its folders, so that
    those outside the range are not listed (bounds known only at run time prune then)."""
    for bound, later in ((start, True), (end, False)):
        if bound is not None:
            prices = prices.where(F.col("date") >= bound if later else F.col("date") <= bound)
            if YEAR in prices.columns:
                prices = prices.where(F.col(YEAR) >= F.year(bound) if later else F.col(YEAR) <= F.year(bound))
    return prices


def read_prices(spark: SparkSession, source: str, fmt: str = "parquet",
                options: dict | None = None, **columns) -> DataFrame:
    """Read prices from a path (``fmt`` = parquet/orc/csv/json/...) or, with
    ``fmt="table"``, from a catalog table."""
    try:
        if fmt == "table":
            raw = spark.table(source)
        else:
            reader = spark.read.format(fmt)
            for k, v in (options or {}).items():
                reader = reader.option(k, v)
            raw = reader.load(source)
    except AnalysisException as e:  # missing path/table, unreadable format
        raise DataFetchError(source, e) from e
    return normalize_prices(raw, **columns)


def write_bucketed_prices(prices: DataFrame, table: str, num_buckets: int, path: str | None = None,
                          mode: str = "overwrite") -> None:
    """Store prices as a catalog table bucketed (and sorted) by ticker.

    Every job here clusters by ``ticker`` (the request join, the feature,
    split and moment windows, the serving history).  Reading a table
    bucketed on ``ticker`` satisfies that clustering at the scan, so the
    price rows are not shuffled at all; only the small request side is
    exchanged to the bucket count.  Pick ``num_buckets`` so one bucket is a
    comfortable task (e.g. total size / 256 MB).  The ``repartition`` makes
    one file per bucket.
    """
    w = (normalize_prices(prices).repartition(num_buckets, "ticker")
         .write.mode(mode).bucketBy(num_buckets, "ticker").sortBy("ticker", "date").format("parquet"))
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def write_yearly_prices(prices: DataFrame, table: str, num_buckets: int, path: str | None = None,
                        mode: str = "overwrite") -> None:
    """Two levels: a folder per year, in each the tickers in ``num_buckets`` buckets.

    A look-back window of three years reads three or four folders of any history, and
    what it reads still lies by ticker, so the price rows are not shuffled (a bucket's files of
    several years make one task).  A new day touches the newest folder only."""
    rows = normalize_prices(prices.drop(YEAR)).withColumn(YEAR, F.year("date"))
    w = (rows.repartition(num_buckets, "ticker").sortWithinPartitions(YEAR, "ticker", "date")
         .write.mode(mode).partitionBy(YEAR).bucketBy(num_buckets, "ticker").sortBy("ticker", "date").format("parquet"))
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def daily_close(ticks: DataFrame, ts: str = "ts", ticker: str = "ticker",
                price: str = "price", day: str | None = None) -> DataFrame:
    """Reduce several rows per ticker and day to the day's last price (by
    ``ts``, which may be a struct with tie-breaks if ``day`` names the time).

    ``max_by`` is a partial aggregate keyed by ``(ticker, date)``: a ticker
    holding a third of all rows is spread over the shuffle by its dates and
    reduced map-side, and afterwards holds one row per day, which bounds
    every later window partition by the date range.
    """
    return (ticks.groupBy(F.col(ticker).cast("string").alias("ticker"), F.to_date(F.col(day or ts)).alias("date"))
            .agg(F.max_by(F.col(price).cast("double"), F.col(ts)).alias("close")))


def prices_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Fixture adapter: one series per supplier, the day's highest line price.

    ``max`` is exact and order-independent; the aggregate runs partial
    (map side) before the shuffle, so even a supplier with a third of all
    line items ships one row per (ticker, date) per task.  The date filter a
    caller puts on the result is pushed below the aggregate into the scan.
    """
    return (
        lineitem
        .groupBy(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
        )
        .agg(F.max("l_extendedprice").alias("close"))
    )


def fixture_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
