"""Fixture views derived from the driver's test tables (see FIXTURES.md).

* ``prices``   - one series per supplier from ``lineitem``;
* ``requests`` - every supplier ticker x horizons {5, 10, 30}, plus a ticker
  with no data;
* ``registry`` - two training runs (back-dated to mid-2001, and the year
  end) with the year-end 10-day versions deleted by tombstones.

All of it is derived lazily from the tables, so its size follows the
scale factor.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import utc_instant
from .prices import fixture_prices

# --- fixed values: fixture parameters ----------------------------------------
HORIZONS = (5, 10, 30)
AS_OF = "2001-12-31"                 # every series ends 2001-09-24 .. 2001-11-04
ONE_TICKER = "ALL"
OTHER_COUNTRY, CALENDAR_END = "XX", "2002-03-31"
BOOK_DAYS = ("2001-09-14", "2001-10-19", "2001-11-30", AS_OF)   # day-by-day training: start and steps
BLOCK_ROWS, BUCKET_DAYS = 64, 128    # small, so that the one series is cut into many blocks
NO_DATA_TICKER = "ZZZZ"
NOW = "2001-12-31 22:00:00"          # UTC; 17:00 New York, after the close
HISTORY_DAYS = 900                   # the default 180 leaves no feature rows here
RUN1_AS_OF = "2001-06-29"
RUN1_TRAINED_AT = "2001-06-29 21:00:00"   # UTC; 17:00 New York (EDT)
RUN2_AS_OF = AS_OF
RUN2_TRAINED_AT = "2001-12-31 21:45:00"   # UTC; 16:45 New York (EST)
DELETED_HORIZON = 10                 # run-2 versions of this horizon are deleted
DELETED_AT = "2002-01-02 15:00:00"
# UTC: business day before its close, after it, Saturday, New Year's Day, long after both runs
INSTANTS = ("2001-12-31 17:00:00", "2001-12-31 21:50:00", "2001-12-29 18:00:00", "2002-01-01 23:00:00", "2002-03-05 22:30:00")
EVENTS_AS_OF = "2024-01-31"          # events cover 30 days of January 2024
EVENTS_NOW = "2024-01-31 22:00:00"

Registry = namedtuple("Registry", ["models", "tombstones"])


def segment_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: one series per market segment, the day's largest
    order.  Five keys hold all orders, so this is the hot-key case: the
    join is on customer keys and the daily ``max`` runs partial (map side)
    before the shuffle on (segment, date)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date"))
            .agg(F.max("o_totalprice").alias("close")))


def segment_requests(spark: SparkSession, sf_dir: str, horizons=HORIZONS) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    seg = c.select(F.col("c_mktsegment").alias("ticker")).distinct()
    return seg.select("ticker", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("forecast_days"))


def line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that rise by one with every day on which their segment has an order."""
    days = segment_prices(spark, sf_dir).select("ticker", "date")
    return days.withColumn("close", 150.0 + F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as a single series, the day's highest price: one key holds every row."""
    p = fixture_prices(spark, sf_dir)
    return p.groupBy("date").agg(F.max("close").alias("close")).select(F.lit(ONE_TICKER).alias("ticker"), "date", "close")


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calendars over the span of the prices and the instants: the built-in one, and one
    that works from Sunday to Thursday and closes on the last day of the year."""
    from ..operators import sessions
    span = fixture_prices(spark, sf_dir).agg(F.min("date").alias("start"), F.lit(CALENDAR_END).cast("date").alias("end"))
    us = sessions.united_states(span)
    d = F.col("date")
    open_day = ~F.dayofweek(d).isin(6, 7) & ~((F.month(d) == 12) & (F.dayofmonth(d) == 31))
    return us.unionByName(us.select(F.lit(OTHER_COUNTRY).alias("country"), "date", open_day.alias("is_business_day")))


def with_country(rows: DataFrame) -> DataFrame:
    odd = F.coalesce(F.substring("ticker", 2, 9).try_cast("int"), F.lit(0)) % 2 == 1
    return rows.withColumn("country", F.when(odd, F.lit("US")).otherwise(F.lit(OTHER_COUNTRY)))


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-history source: one series per event type over 30 days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (e.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
            .agg(F.max("value").alias("close")))


def requests(spark: SparkSession, sf_dir: str, horizons=HORIZONS) -> DataFrame:
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    tick = sup.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    grid = tick.select("ticker", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("forecast_days"))
    # a Range leaf (not a local RDD) keeps plans canonical, so repeated uses share exchanges
    extra = spark.range(1).select(F.lit(NO_DATA_TICKER).alias("ticker"), F.lit(5).alias("forecast_days"))
    return grid.unionByName(extra)


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    from ..plans.train import train_all
    prices = fixture_prices(spark, sf_dir)
    req = requests(spark, sf_dir)
    r1 = train_all(prices, req, RUN1_AS_OF, now=RUN1_TRAINED_AT, horizons=HORIZONS)
    r2 = train_all(prices, req, RUN2_AS_OF, now=RUN2_TRAINED_AT, horizons=HORIZONS)
    models = r1.models.unionByName(r2.models)
    tombs = (r2.models.where(F.col("forecast_days") == DELETED_HORIZON)
             .select("ticker", "forecast_days", "trained_at",
                     utc_instant(DELETED_AT).alias("deleted_at")))
    return Registry(models, tombs)
