"""Chronological splits.

The reference builds ``TimeSeriesSplit(n_splits)`` with
``n_splits = max(2, int(1 / test_size))`` and keeps only the last fold.
For a series of ``n`` rows the fold size is ``ts = floor(n / (n_splits+1))``
and fold ``f`` (1-based) tests rows ``start < i <= start + ts`` with
``start = n - (n_splits - f + 1) * ts``, training on ``i <= start``.

Both functions are windows over ``(ticker, forecast_days)`` ordered by
date: with the input already partitioned by ``ticker`` they add a local
sort and no exchange.
"""

from __future__ import annotations

from numbers import Real

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

KEYS = ("ticker", "forecast_days")


def n_splits_for(test_size: float = config.DEFAULT_TEST_SIZE) -> int:
    """Folds for a test share: a number strictly between 0 and 1."""
    number = isinstance(test_size, Real) and not isinstance(test_size, bool)
    if not number:
        raise TypeError(f"test share {test_size!r} is no number")
    if test_size <= 0 or test_size >= 1:
        raise ValueError(f"test share {test_size!r} lies outside the open interval from 0 to 1")
    return max(2, int(1 / test_size))


def number_rows(df: DataFrame, keys=KEYS) -> DataFrame:
    """``i`` = 1-based position by date, ``n`` = rows in the key."""
    w = Window.partitionBy(*keys).orderBy("date")
    # Ordered whole-partition frame: shares the sort of the row_number window.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"i": F.row_number().over(w), "n": F.count(F.lit(1)).over(whole)})


def last_fold(df: DataFrame, test_size: float = config.DEFAULT_TEST_SIZE, keys=KEYS) -> DataFrame:
    """Adds ``i, n, n_test, is_test`` (the last fold; train = the rest).

    Keys with ``n <= n_splits`` cannot be split; they get ``is_test`` null
    and are reported by the training job (``TRAINING_FAILED``).
    """
    k = n_splits_for(test_size)
    out = number_rows(df, keys)
    n_test = F.floor(F.col("n") / F.lit(k + 1)).cast("long")
    return out.withColumns({
        "n_test": n_test,
        "is_test": F.when(F.col("n") > k, F.col("i") > F.col("n") - n_test),
    })


def fold_intervals(df: DataFrame, test_size: float = config.DEFAULT_TEST_SIZE, keys=KEYS) -> DataFrame:
    """W10 as two numbers a row, none of which fans out: ``test_fold``, the fold that the
    row is tested in (null: none), and ``first_train_fold``, the first of the folds that train
    on it (it and all later ones; null: none).

    With ``q = floor((n - i) / ts)`` whole folds after the row, it is tested in fold
    ``n_splits - q`` and trained on from the next fold on."""
    k = n_splits_for(test_size)
    out = number_rows(df, keys).where(F.col("n") > k)
    later = F.floor((F.col("n") - F.col("i")) / F.floor(F.col("n") / F.lit(k + 1))).cast("int")
    return out.withColumns({
        "test_fold": F.when(later < k, F.lit(k) - later),
        "first_train_fold": F.when(later >= 1, F.greatest(F.lit(k + 1) - later, F.lit(1))),
    })


def expand_folds(intervals: DataFrame, test_size: float = config.DEFAULT_TEST_SIZE) -> DataFrame:
    """One row per (row, fold it belongs to) with ``role`` train/test."""
    k = n_splits_for(test_size)

    def member(fold: Column, role: str) -> Column:
        return F.struct(fold.alias("fold"), F.lit(role).alias("role"))
    trained = F.when(F.col("first_train_fold").isNotNull(), F.transform(
        F.sequence(F.col("first_train_fold"), F.lit(k)), lambda f: member(f, "train")))
    tested = F.when(F.col("test_fold").isNotNull(), F.array(member(F.col("test_fold"), "test")))
    none = F.array().cast("array<struct<fold:int,role:string>>")
    return intervals.select("*", F.inline(F.concat(F.coalesce(trained, none), F.coalesce(tested, none)))).drop(
        "test_fold", "first_train_fold")


def all_folds(df: DataFrame, test_size: float = config.DEFAULT_TEST_SIZE, keys=KEYS) -> DataFrame:
    """One row per (row, fold it belongs to) with ``role`` train/test.

    Fan-out is at most ``n_splits`` per row (a parameter, not data)."""
    return expand_folds(fold_intervals(df, test_size, keys), test_size)
