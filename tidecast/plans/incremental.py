"""B1 day by day: models kept up to date from moments, not from the whole window.

A full training run reads the look-back window of every series.  Here a ``Book`` is
carried from run to run, and a new day costs what the day changes:

* ``tail``  - the newest price rows of every ticker, numbered (``pos``): max horizon feature
  rows and the 100 rows before them; with the day's new prices they give the feature rows whose target the day
  has made known ("closed" rows);
* ``firsts`` - how many price rows of every ticker lie before the window;
* ``rows``  - closed rows ``(ticker, forecast_days, v, pos, date, closed_on, x0..x3, y)``,
  ``v`` numbering the key's rows, appended in blocks of ``v``;
* ``state`` - per key the range of ``v`` that a fit trains on, and its moments.

A row's features and target do not depend on where the window starts once 100 rows of
its series lie before it, so the training set of any day is a range of ``v``: it starts
behind the window's warm-up and ends before the last fold.  From one day to the next
a few rows enter at its end and leave at its start; their moments are merged in and
taken out, and the models are solved from the state.  Only the blocks of ``rows`` that
hold entering or leaving rows are read (dynamic pruning on ``block``), the new days of the price
table, and the days that drop out of the window.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..operators import features, halo, moments, split
from ..sources.book_store import BookTables
from ..sources.prices import in_range

KEYS = ("ticker", "forecast_days")
ROWS_A_BLOCK = 64
WARM_UP = halo.REACH_BACK  # earlier rows that a feature row needs
ROW = ("ticker", "forecast_days", "v", "pos", "date", "closed_on", *[f"x{i}" for i in range(config.N_SLOTS)], "y")

Book = namedtuple("Book", ["tail", "firsts", "rows", "state", "as_of", "horizons"])


def _date(v) -> Column:
    return F.to_date(F.lit(str(v)))


def closed_rows(numbered: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Prices with ``pos`` -> rows with slots, target and the day the target became known."""
    hs = sorted({int(h) for h in horizons})
    feats = features.build_features(numbered, carry=("pos",))
    known = {f"_d{h}": F.lead("date", h) for h in hs}
    long = features.add_targets(feats, hs, extra=known)
    fd = F.col("forecast_days")
    closed_on = F.coalesce(*[F.when(fd == h, F.col(f"_d{h}")) for h in hs])
    return long.select("ticker", "forecast_days", "pos", "date", closed_on.alias("closed_on"),
                       *features.slot_columns(fd, F.col), F.col("target").alias("y"))


def newest_rows(numbered: DataFrame, max_horizon: int) -> DataFrame:
    """The price rows that later days need: the newest ``max_horizon`` feature rows (targets are
    counted in those: a null close leaves one out) and the rows their lags reach back to."""
    order = Window.partitionBy("ticker").orderBy("date")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = Window.partitionBy("ticker").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered.withColumn("_warm", F.lag("close", WARM_UP).over(order).isNotNull())
    rows = rows.withColumn("_back", F.count_if("_warm").over(back))
    wanted = F.col("_warm") & (F.col("_back") <= max_horizon)
    rows = rows.withColumns({"_all": F.count_if("_warm").over(whole), "_first": F.min(F.when(wanted, F.col("pos"))).over(whole)})
    return rows.where((F.col("_all") < max_horizon) | (F.col("pos") >= F.col("_first") - WARM_UP)).select(*numbered.columns)


def _numbered(rows: DataFrame, first: Column) -> DataFrame:
    order = Window.partitionBy(*KEYS).orderBy("date")
    v = first + F.row_number().over(order)
    return rows.withColumn("v", v.cast("long")).select(*ROW, F.floor(v / ROWS_A_BLOCK).alias("block"))


def _train_range(state: DataFrame, test_size: float) -> DataFrame:
    """Adds ``hi`` to ``lo`` (first row behind the warm-up) and ``last`` (newest closed row):
    rows lo..hi train; without enough rows for the folds none does (hi = lo - 1)."""
    k = split.n_splits_for(test_size)
    n = F.greatest(F.col("last") - F.col("lo") + 1, F.lit(0))
    hi = F.when(n > k, F.col("last") - F.floor(n / (k + 1))).otherwise(F.col("lo") - 1)
    return state.withColumn("hi", hi)


def start(prices: DataFrame, as_of, horizons: Iterable[int], tables: BookTables,
          test_size: float = config.DEFAULT_TEST_SIZE, lookback_days: int = config.TRAIN_LOOKBACK_DAYS) -> Book:
    """The book as of a day, from the whole history up to it."""
    hs = sorted({int(h) for h in horizons})
    numbered = tables.keep(halo.positions(in_range(prices, end=_date(as_of)).select("ticker", "date", "close")), "numbered")
    tail = tables.keep(newest_rows(numbered, max(hs)), "tail")
    rows, _ = tables.append(_numbered(closed_rows(numbered, hs), F.lit(0)), as_of)
    early = F.col("date") < F.date_sub(_date(as_of), lookback_days)
    firsts = tables.keep(numbered.groupBy("ticker").agg(F.count_if(early).alias("first_pos")), "firsts")
    ranged = rows.join(firsts, "ticker").groupBy(*KEYS).agg(
        F.max("v").alias("last"),
        (F.count_if(F.col("pos") < F.col("first_pos") + WARM_UP) + 1).alias("lo"))
    ranged = tables.keep(_train_range(ranged, test_size), "ranges")
    used = rows.join(ranged.select(*KEYS, "lo", "hi"), list(KEYS)).where(F.col("v").between(F.col("lo"), F.col("hi")))
    state = ranged.join(moments.of_rows(used).withColumn("m", moments.as_struct()).select(*KEYS, "m"), list(KEYS), "left")
    state = state.select(*KEYS, "lo", "hi", "last", F.coalesce("m", moments.nothing()).alias("m"))
    return Book(tail, firsts, rows, tables.keep(state, "state"), as_of, hs)


def _rows_in(rows: DataFrame, wanted: DataFrame, tables: BookTables) -> DataFrame:
    """The rows whose ``v`` lies in their key's ``a..b``; only the blocks that hold some are read.
    The keys' blocks are written first: by their size Spark broadcasts them where it can, and
    the rows then meet them where they lie."""
    blocks = wanted.where(F.col("a") <= F.col("b")).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("a") / ROWS_A_BLOCK), F.floor(F.col("b") / ROWS_A_BLOCK))))
    return rows.join(tables.keep(blocks, "blocks"), [*KEYS, "block"]).where(F.col("v").between(F.col("a"), F.col("b")))


def advance(book: Book, prices: DataFrame, as_of, tables: BookTables, test_size: float = config.DEFAULT_TEST_SIZE,
            lookback_days: int = config.TRAIN_LOOKBACK_DAYS) -> Book:
    """The book as of a later day.  Of ``prices`` only the days after ``book.as_of`` and the
    days that drop out of the window are read."""
    was, now = _date(book.as_of), _date(as_of)
    names = ("ticker", "date", "close")
    fresh = in_range(prices, F.date_add(was, 1), now).select(*names)
    dropped = in_range(prices, F.date_sub(was, lookback_days), F.date_sub(now, lookback_days + 1)).select(*names)

    # the new rows' numbers go on where the tail ends; series that begin now start at 0
    ends = book.tail.groupBy("ticker").agg((F.max("pos") + 1).alias("_next"))
    order = Window.partitionBy("ticker").orderBy("date")
    fresh = fresh.join(ends, "ticker", "left").withColumn(
        "pos", F.coalesce("_next", F.lit(0)) + F.row_number().over(order) - 1).drop("_next")
    known = tables.keep(book.tail.unionByName(fresh), "known")
    tail = tables.keep(newest_rows(known, max(book.horizons)), "tail")
    gone = dropped.groupBy("ticker").agg(F.count(F.lit(1)).alias("gone"))
    firsts = tables.keep(tail.select("ticker").distinct().join(book.firsts, "ticker", "left").join(gone, "ticker", "left").select(
        "ticker", (F.coalesce("first_pos", F.lit(0)) + F.coalesce("gone", F.lit(0))).alias("first_pos"),
        F.coalesce("gone", F.lit(0)).alias("gone")), "firsts")

    # rows closed since, numbered on from the key's last
    closed = closed_rows(known, book.horizons).where((F.col("closed_on") > was) & (F.col("closed_on") <= now))
    closed = closed.join(book.state.select(*KEYS, "last"), list(KEYS), "left")
    rows, more = tables.append(_numbered(closed, F.coalesce("last", F.lit(0))), as_of)
    added = more.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("added"))
    old = book.state.join(added, list(KEYS), "full").join(firsts, "ticker").select(
        *KEYS, F.coalesce("lo", F.lit(1)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"),
        (F.coalesce("last", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("last"), "first_pos",
        (F.coalesce("added", F.lit(0)) + F.col("gone")).alias("moved"), F.coalesce("m", moments.nothing()).alias("m"))
    # a dropped day, and a row closed behind the warm-up, each move the first row by one at most
    near = old.select(*KEYS, F.col("lo").alias("a"), F.least(F.col("lo") + F.col("moved") - 1, F.col("last")).alias("b"),
                      (F.col("first_pos") + WARM_UP).alias("from_pos"))
    behind = _rows_in(rows, near, tables).where(F.col("pos") < F.col("from_pos")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("behind"))
    ranged = old.join(behind, list(KEYS), "left").select(
        *KEYS, F.col("lo").alias("lo_was"), F.col("hi").alias("hi_was"), (F.col("lo") + F.coalesce("behind", F.lit(0))).alias("lo"), "last", "m")
    ranged = tables.keep(_train_range(ranged, test_size), "ranges")

    # leaving: lo_was .. min(hi_was, lo - 1); entering: max(hi_was + 1, lo) .. hi; a key that can no longer be split starts again
    none = F.col("hi") < F.col("lo")
    out = ranged.where(~none).select(*KEYS, F.col("lo_was").alias("a"), F.least(F.col("hi_was"), F.col("lo") - 1).alias("b"))
    into = ranged.where(~none).select(*KEYS, F.greatest(F.col("hi_was") + 1, F.col("lo")).alias("a"), F.col("hi").alias("b"))
    away = moments.of_rows(_rows_in(rows, out, tables)).withColumn("away", moments.as_struct()).select(*KEYS, "away")
    came = moments.of_rows(_rows_in(rows, into, tables)).withColumn("came", moments.as_struct()).select(*KEYS, "came")
    state = ranged.join(away, list(KEYS), "left").join(came, list(KEYS), "left")
    state = state.withColumn("m", moments.without(F.col("m"), F.col("away")))
    state = state.withColumn("m", moments.merged(F.col("m"), F.col("came")))
    state = state.select(*KEYS, "lo", "hi", "last", F.when(none, moments.nothing()).otherwise(F.col("m")).alias("m"))
    return Book(tail, firsts.drop("gone"), rows, tables.keep(state, "state"), as_of, book.horizons)


def models(book: Book) -> DataFrame:
    """One model row per key that can be split: ``keys, n, w0..w3, intercept``."""
    return moments.fit(book.state.select(*KEYS, "m.*"))
