"""Feature frame, horizon targets and feature slots.

All windows partition by ``ticker`` and order by ``date``; they share one
exchange and one sort.  A ``(ticker, date)`` series holds at most one row per
calendar day, so a window partition is bounded by the date span no matter
how many rows the whole table has.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import config
from ..sources.prices import in_range


def series_window() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def restrict(prices: DataFrame, start=None, end=None, tickers: DataFrame | None = None) -> DataFrame:
    """Ticker and inclusive date-range filters, placed *before* the
    windows (moving the date filter above them would change the lags).

    ``tickers`` is a DataFrame with a ``ticker`` column (a request table);
    a ``left_semi`` join keeps the requested series.  Its exchange on
    ``ticker`` is the same one the windows need.
    """
    out = in_range(prices, None if start is None else _as_date(start), None if end is None else _as_date(end))
    if tickers is not None:
        out = out.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return out


def _as_date(v) -> Column:
    return v if isinstance(v, Column) else F.to_date(F.lit(str(v)))


def feature_columns(price: str = "close", window: WindowSpec | None = None) -> list[Column]:
    """Lags and trailing row averages of ``price`` over ``window`` (a whole series)."""
    w = window or series_window()
    cols = [F.lag(price, k).over(w).alias(f"lag{k}") for k in config.LAGS]
    cols += [F.avg(price).over(w.rowsBetween(-(k - 1), 0)).alias(f"ma{k}")
             for k in config.MOVING_AVERAGES]
    return cols


def count_repeated_days(prices: DataFrame) -> DataFrame:
    """Adds ``n_dup``: how many rows of the ticker fall on a day that an earlier row has.

    Every operator takes one row per ticker and day (P2); the count rides on
    the windows' own sort, so the check costs no exchange."""
    w = series_window()
    again = F.coalesce(F.lag("date").over(w) == F.col("date"), F.lit(False)).cast("int")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return prices.withColumn("_again", again).withColumn("n_dup", F.sum("_again").over(whole)).drop("_again")


def build_features(prices: DataFrame, start=None, end=None,
                   tickers: DataFrame | None = None, warm_up: bool = True,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """S1+P1-P5: ``(ticker, date, price, lag1..lag100, ma5..ma100)``.

    Rows inside the warm-up (no ``lag100``/``ma100``) are dropped, so every
    series loses its first 100 rows of the selected range.  ``carry`` names
    extra per-ticker columns passed through unchanged.
    """
    base = restrict(prices, start, end, tickers)
    feats = base.select("ticker", "date", F.col("close").alias("price"), *carry,
                        *feature_columns())
    return feats.where(warmed_up()) if warm_up else feats


def warmed_up() -> Column:
    """P5: the row lies behind the warm-up."""
    return F.col("lag100").isNotNull() & F.col("ma100").isNotNull()


def add_targets(features: DataFrame, horizons: Iterable[int], keep_invalid: bool = False,
                extra: dict[str, Column] | None = None, window: WindowSpec | None = None) -> DataFrame:
    """W8 + P6: ``target = price`` *h* rows ahead, one row per (ticker, horizon, date).

    One ``lead`` per distinct horizon is computed in one window node over the
    feature frame (after the warm-up filter, with the same partitioning and
    ordering, so no new exchange or sort), then unpivoted with ``inline``.
    Rows with a null in *any* column - the nine feature columns and the
    target, selected or not - are dropped, as the reference does; with
    ``keep_invalid`` they are kept and flagged ``valid = false`` instead.

    A ``horizons array<int>`` column on ``features`` restricts each ticker to
    the horizons it asked for.  ``extra`` adds window columns (over
    ``window``, by default ``series_window``) computed in the same node.
    """
    hs = sorted({int(h) for h in horizons})
    if not hs:
        raise ValueError("at least one horizon is required")
    bad = [h for h in hs if h < 1 or h > config.MAX_HORIZON]
    if bad:
        raise ValueError(f"horizons out of range 1..{config.MAX_HORIZON}: {bad}")
    w = window or series_window()
    restricted = "horizons" in features.columns
    keep = ["ticker", "date", "price", *config.FEATURE_COLUMNS]
    carried = [c for c in features.columns if c not in keep]
    with_leads = features.select(
        *keep, *carried, *[F.lead("price", h).over(w).alias(f"_t{h}") for h in hs],
        *[c.over(w).alias(n) for n, c in (extra or {}).items()])
    pairs = F.array(*[F.struct(F.lit(h).alias("forecast_days"), F.col(f"_t{h}").alias("target"))
                      for h in hs])
    if restricted:  # before the rows fan out: a row makes one row per horizon its ticker asked for
        pairs = F.filter(pairs, lambda p: F.array_contains("horizons", p["forecast_days"]))
    long = with_leads.select(*keep, *carried, *(extra or {}).keys(), F.inline(pairs))
    valid = F.lit(True)
    for c in list(config.REQUIRED_COLUMNS) + ["target"]:
        valid = valid & F.col(c).isNotNull()
    out_cols = ["ticker", "forecast_days", "date", "price", *config.FEATURE_COLUMNS, "target",
                *[c for c in carried if c != "horizons"], *(extra or {}).keys()]
    if keep_invalid:
        return long.select(*out_cols, valid.alias("valid"))
    return long.where(valid).select(*out_cols)


def tier_features(forecast_days: Column) -> Column:
    """The feature names a horizon uses, as ``array<string>``."""
    def arr(names):
        return F.array(*[F.lit(n) for n in names])
    return (F.when(forecast_days <= config.SHORT_TERM_MAX_HORIZON, arr(config.SHORT_TERM_FEATURES))
            .when(forecast_days <= config.MEDIUM_TERM_MAX_HORIZON, arr(config.MEDIUM_TERM_FEATURES))
            .otherwise(arr(config.LONG_TERM_FEATURES)))


def slot_columns(forecast_days: Column, value_of) -> list[Column]:
    """P7 as slots ``x0..x3``: ``value_of(name)`` gives the Column of a feature.

    The long tier has three features; its fourth slot is the constant 0.0,
    which the solver turns into a zero coefficient.
    """
    tiers = (config.SHORT_TERM_FEATURES, config.MEDIUM_TERM_FEATURES,
             config.LONG_TERM_FEATURES + ("",))
    out = []
    for i in range(config.N_SLOTS):
        short, medium, long = (t[i] for t in tiers)
        out.append(
            F.when(forecast_days <= config.SHORT_TERM_MAX_HORIZON, value_of(short))
            .when(forecast_days <= config.MEDIUM_TERM_MAX_HORIZON, value_of(medium))
            .otherwise(value_of(long) if long else F.lit(0.0))
            .alias(f"x{i}"))
    return out


def select_slots(targets: DataFrame) -> DataFrame:
    """``(ticker, forecast_days, date, x0..x3, y)``."""
    fd = F.col("forecast_days")
    return targets.select("ticker", "forecast_days", "date",
                          *slot_columns(fd, F.col), F.col("target").alias("y"))
