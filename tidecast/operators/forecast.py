"""Serving history and recursive forecasts.

Serving state per series is its newest <= 100 feature-frame prices, cut by a
window *before* they are collected, so every ``collect_list`` holds at most
100 values whatever the series length.  The recursion is a Catalyst
``aggregate`` over ``sequence(1, h)``, one row per (series, horizon), no Python
and no shuffle.  Its state is a running sum per moving average and the predictions in
chunks, so a step costs the same however many came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import calendar
from . import features
from ..sources.prices import in_range
from .business_calendar import next_business_days_via_calendar

KEYS = ("ticker", "forecast_days")


def _date(v) -> Column:
    return v if isinstance(v, Column) else F.to_date(F.lit(str(v)))


def serving_frame(prices: DataFrame, history_days: int = config.FORECAST_HISTORY_DAYS,
                  as_of=None) -> DataFrame:
    """P10 + A1/A13 + P13: the feature frame over
    ``[latest_date - history_days, latest_date]`` of each series, with
    ``latest_date`` and the frame's row count ``n_hist`` on every row.

    ``as_of`` back-dates the data (``date <= as_of``).  The latest dates come
    from a partial aggregate (one row per ticker and task); prices are cut to
    the serving range by a join with them, below the windows, and the oldest
    date that any series needs is a scalar bound on the scan, so older
    partitions and row groups are skipped and full history is neither sorted
    nor buffered.
    """
    src = in_range(prices, end=None if as_of is None else _date(as_of))
    latest = src.groupBy("ticker").agg(F.max("date").alias("latest_date"))
    oldest = latest.agg(F.date_sub(F.min("latest_date"), history_days)).scalar()
    ends = latest.select(F.col("ticker").alias("_of"), "latest_date")
    recent = in_range(src, start=oldest)
    ranged = (recent.join(ends, F.col("ticker") == F.col("_of")).drop("_of")
              .where(F.col("date") >= F.date_sub(F.col("latest_date"), history_days)))
    whole = features.series_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    feats = features.build_features(features.count_repeated_days(ranged), carry=("latest_date", "n_dup"))
    return feats.withColumns({
        "rn": F.row_number().over(features.series_window()),
        "n_hist": F.count(F.lit(1)).over(whole),
    })


def history_tail(prices: DataFrame, history_days: int = config.FORECAST_HISTORY_DAYS,
                 as_of=None, tail: int = config.SERVING_TAIL_ROWS) -> DataFrame:
    """The newest ``tail`` rows of each serving frame
    (``rn_desc`` = 1 is the newest)."""
    f = serving_frame(prices, history_days, as_of)
    return (f.where(F.col("rn") > F.col("n_hist") - tail)
            .select("ticker", "date", "price", "latest_date", "n_hist", "n_dup",
                    (F.col("n_hist") - F.col("rn") + 1).alias("rn_desc")))


def history_arrays(prices: DataFrame, history_days: int = config.FORECAST_HISTORY_DAYS,
                   as_of=None, tail: int = config.SERVING_TAIL_ROWS) -> DataFrame:
    """``(ticker, latest_date, n_hist, hist array<double>)`` oldest first.

    ``collect_list`` order is undefined, so (date, price) structs are
    sorted before the prices are extracted; each list holds <= ``tail``.
    """
    t = history_tail(prices, history_days, as_of, tail)
    return (t.groupBy("ticker")
            .agg(F.max("latest_date").alias("latest_date"), F.max("n_hist").alias("n_hist"), F.max("n_dup").alias("n_dup"),
                 F.sort_array(F.collect_list(F.struct("date", "price"))).alias("_h"))
            .select("ticker", "latest_date", "n_hist", "n_dup",
                    F.transform("_h", lambda s: s["price"]).alias("hist")))


# --- array features (R1, W11, A12) ------------------------------------------

def lag_from_end(arr: Column, k: int) -> Column:
    """K-th value from the end, clamped to the oldest when shorter."""
    n = F.size(arr)
    return F.element_at(arr, n - F.least(F.lit(k), n) + 1)


def mean_of_last(arr: Column, k: int) -> Column:
    """Mean of the last ``min(k, size)`` values."""
    n = F.size(arr)
    m = F.least(F.lit(k), n)
    window = F.slice(arr, n - m + 1, m)
    return F.aggregate(window, F.lit(0.0), lambda acc, x: acc + x) / m


def array_feature(arr: Column, name: str) -> Column:
    if name.startswith("lag"):
        return lag_from_end(arr, int(name[3:]))
    return mean_of_last(arr, int(name[2:]))


def serving_feature_columns(arr: Column) -> dict[str, Column]:
    """All seven serving features of a price array."""
    return {name: array_feature(arr, name) for name in config.FEATURE_COLUMNS}


def tier_prediction(forecast_days: Column, feature) -> Column:
    """``intercept + sum w_i * feature(name_i)`` with the tier's features (the long
    tier has three)."""
    def tier(names):
        out = F.col("intercept")
        for i, name in enumerate(names):
            out = out + F.col(f"w{i}") * feature(name)
        return out
    return (F.when(forecast_days <= config.SHORT_TERM_MAX_HORIZON, tier(config.SHORT_TERM_FEATURES))
            .when(forecast_days <= config.MEDIUM_TERM_MAX_HORIZON, tier(config.MEDIUM_TERM_FEATURES))
            .otherwise(tier(config.LONG_TERM_FEATURES)))


def next_prediction(arr: Column, forecast_days: Column) -> Column:
    """T11 on the serving features of a price array."""
    return tier_prediction(forecast_days, lambda name: array_feature(arr, name))


# --- the recursion's state (R3) ------------------------------------------------
# The series at a step is ``hist`` followed by the predictions so far.  ``hist`` is never
# copied; the predictions are kept in chunks, of which a step copies at most one, and the
# moving averages as running sums, so a step costs the same however long the series is.

CHUNK = 20


def first_state(hist: Column) -> Column:
    """``s{k}``: the sum of the newest min(k, size) prices; no predictions yet."""
    def total(k: int) -> Column:
        newest = F.slice(hist, F.greatest(F.size(hist) - k + 1, F.lit(1)), k)
        return F.aggregate(newest, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(F.size(hist).alias("n"), *[total(k).alias(f"s{k}") for k in config.MOVING_AVERAGES],
                    F.array().cast("array<double>").alias("chunk"), F.array().cast("array<array<double>>").alias("chunks"))


def from_end(hist: Column, state: Column, k: int) -> Column:
    """The k-th price from the end, clamped to the oldest when there are fewer."""
    at = F.greatest(state["n"] - k, F.lit(0))
    ahead = at - F.size(hist)
    chunk, place = F.floor(ahead / CHUNK).cast("int"), ahead % CHUNK
    return (F.when(ahead < 0, hist[at])
            .when(chunk < F.size(state["chunks"]), state["chunks"][chunk][place])
            .otherwise(state["chunk"][place]))


def state_feature(hist: Column, state: Column, name: str) -> Column:
    """R1 from the state: one price, or a running sum over its count."""
    k = int(name[3:] if name.startswith("lag") else name[2:])
    if name.startswith("lag"):
        return from_end(hist, state, k)
    return state[f"s{k}"] / F.least(F.lit(k), state["n"])


def next_state(hist: Column, state: Column, price: Column, forecast_days: Column) -> Column:
    """The state after ``price`` has become the newest: it enters the sums that the tier
    uses, and the price that is then k + 1 rows back leaves them."""
    def total(k: int) -> Column:
        gone = F.when(state["n"] >= k, from_end(hist, state, k)).otherwise(0.0)
        return F.when(F.array_contains(features.tier_features(forecast_days), f"ma{k}"), state[f"s{k}"] + price - gone)
    full = F.size(state["chunk"]) == CHUNK - 1
    grown = F.concat(state["chunk"], F.array(price))
    return F.struct(
        (state["n"] + 1).alias("n"), *[total(k).alias(f"s{k}") for k in config.MOVING_AVERAGES],
        F.when(full, F.array().cast("array<double>")).otherwise(grown).alias("chunk"),
        F.when(full, F.concat(state["chunks"], F.array(grown))).otherwise(state["chunks"]).alias("chunks"))


def predictions(hist: Column, forecast_days: Column) -> Column:
    """The next ``forecast_days`` prices, each predicted from the newest ones before it.

    The step's price is bound once (the one-element ``transform``), not written out in
    every place that uses it."""
    def step(state: Column, _: Column) -> Column:
        price = tier_prediction(forecast_days, lambda name: state_feature(hist, state, name))
        return F.element_at(F.transform(F.array(price), lambda p: next_state(hist, state, p, forecast_days)), 1)

    end = F.aggregate(F.sequence(F.lit(1), forecast_days), first_state(hist), step)
    joined = F.transform(F.array(end), lambda e: F.concat(F.flatten(e["chunks"]), e["chunk"]))
    return F.element_at(joined, 1)


def recursive_forecast(df: DataFrame, business_calendar: DataFrame | None = None) -> DataFrame:
    """Rows ``(ticker, forecast_days, latest_date, hist, w0..w3, intercept)``
    -> one row per step ``(ticker, forecast_days, step, date, predicted_price)``.

    Each step predicts from the newest prices (``predictions``) and takes the
    prediction as the newest price; dates are the next ``forecast_days`` business days
    after ``latest_date`` (T2): by the built-in US rules, or - given a
    calendar table ``(date, is_business_day, bd_index)`` such as
    ``business_calendar.calendar_between`` or a user's own - by the J4
    equi-join on ``bd_index``.
    """
    fd = F.col("forecast_days")
    preds = predictions(F.col("hist"), fd)
    if business_calendar is not None:
        steps = df.select("ticker", "forecast_days", "latest_date",
                          F.posexplode(preds).alias("_pos", "predicted_price"))
        steps = steps.select("ticker", "forecast_days", "latest_date", (F.col("_pos") + 1).alias("step"),
                             "predicted_price")
        dated = next_business_days_via_calendar(steps, business_calendar, step_col="step")
        return dated.select("ticker", "forecast_days", "step", "date", "predicted_price")
    dates = calendar.next_business_days(F.col("latest_date"), fd)
    zipped = F.arrays_zip(preds.alias("p"), dates.alias("d"))
    return (df.select("ticker", "forecast_days", F.posexplode(zipped).alias("_pos", "_z"))
            .select("ticker", "forecast_days", (F.col("_pos") + 1).alias("step"),
                    F.col("_z.d").alias("date"), F.col("_z.p").alias("predicted_price")))


def single_prediction(df: DataFrame, date: str | None = None) -> DataFrame:
    """R2: one prediction per model row (any version) from its serving features,
    with the names of the features used.  ``date`` names a column that is
    echoed; without one the next business day is reported."""
    fd = F.col("forecast_days")
    day = F.col(date) if date else F.element_at(calendar.next_business_days(F.col("latest_date"), 1), 1)
    return df.select("ticker", "forecast_days", "version", day.alias("date"),
                     next_prediction(F.col("hist"), fd).alias("predicted_price"),
                     features.tier_features(fd).alias("features_used"))
