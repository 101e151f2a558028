"""Registered queries: one per operator group of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver's tables
(through the fixture views in ``sources.fixtures``).  Doubles are rounded
for an exact cross-engine comparison: 6 decimals for averages, slopes and
ratios, 2 for price-scale values (intercepts, errors, predictions); the
centred moments are rendered with 9 significant digits.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import calendar, quality, versions
from ..functions.instants import ensure_utc, utc_instant
from ..operators import business_calendar, evaluate, features, forecast, freshness, halo, ols, registry, sessions, split
from ..schema import missing_columns
from ..session import checkpoint_dir, cut_lineage
from ..sources import fixtures, registry_store
from ..sources.book_store import BookTables
from ..sources.prices import daily_close, fixture_prices, read_prices, write_yearly_prices
from . import forecast as fplan
from . import incremental, jobs, report, train

MA = ("ma5", "ma20", "ma100")
LAG = ("lag1", "lag5", "lag20", "lag100")


def _ts(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _i64(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _feature_projection(df: DataFrame) -> DataFrame:
    return df.select("ticker", "date", "price", *LAG, *[F.round(m, 6).alias(m) for m in MA])


def _train_features(spark, sf) -> DataFrame:
    return features.build_features(train.training_window(fixture_prices(spark, sf), fixtures.AS_OF))


def _targets(spark, sf) -> DataFrame:
    return features.add_targets(_train_features(spark, sf), fixtures.HORIZONS)


def _slots(spark, sf) -> DataFrame:
    return features.select_slots(_targets(spark, sf))


def _split(spark, sf) -> DataFrame:
    return split.last_fold(_slots(spark, sf)).where(F.col("is_test").isNotNull())


def _year_end_models(spark, sf) -> DataFrame:
    res = train.train_all(fixture_prices(spark, sf), fixtures.requests(spark, sf), fixtures.AS_OF,
                          now=fixtures.NOW, horizons=fixtures.HORIZONS)
    return res.models


def _metric_projection(df: DataFrame) -> list[Column]:
    return [F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"),
            F.round("mape", 6).alias("mape"), F.round("max_ae", 2).alias("max_ae"),
            _i64("train_samples").alias("train_samples"), _i64("test_samples").alias("test_samples")]


# --- S1 P1 P2 P3 P4 P5 W1-W7 O1 -----------------------------------------------

def q_features(spark, sf):
    return _feature_projection(features.build_features(fixture_prices(spark, sf)))


def _one_series_features(spark, sf):
    return halo.build_features(fixtures.one_series(spark, sf), block_rows=fixtures.BLOCK_ROWS, bucket_days=fixtures.BUCKET_DAYS)


def q_features_one_series(spark, sf):
    """W1-W7 on a single series, cut into blocks with a halo."""
    return _feature_projection(_one_series_features(spark, sf))


def q_targets_one_series(spark, sf):
    """W8 likewise; horizons up to more rows than a block has."""
    t = halo.add_targets(_one_series_features(spark, sf), (*fixtures.HORIZONS, 100), block_rows=fixtures.BLOCK_ROWS,
                         bucket_days=fixtures.BUCKET_DAYS)
    return t.select("ticker", _i64("forecast_days").alias("forecast_days"), "date", "price", "target")


def q_features_in_range(spark, sf):
    f = features.build_features(fixture_prices(spark, sf), start="1997-01-01", end="2000-12-31",
                                tickers=fixtures.requests(spark, sf))
    return _feature_projection(f)


# --- A1 A2 P12 T7 ---------------------------------------------------------------

def q_latest_date(spark, sf):
    tick = fixtures.requests(spark, sf).select("ticker").distinct()
    latest = fixture_prices(spark, sf).groupBy("ticker").agg(F.max("date").alias("latest_date"))
    out = tick.join(latest, "ticker", "left")
    return out.select("ticker", "latest_date",
                      F.when(F.col("latest_date").isNull(), F.lit(config.INSUFFICIENT_DATA)).alias("error_code"))


def q_sufficiency_guard(spark, sf):
    p = fixture_prices(spark, sf)
    tick = fixtures.requests(spark, sf).select("ticker").distinct()
    trained = _train_features(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    counts = trained.select("ticker", F.lit("train_1095").alias("frame"), "n")
    for days in (180, 900):
        served = (forecast.serving_frame(p, days, fixtures.AS_OF)
                  .groupBy("ticker").agg(F.count(F.lit(1)).alias("n")))
        counts = counts.unionByName(served.select("ticker", F.lit(f"serve_{days}").alias("frame"), "n"))
    grid = tick.select("ticker", F.explode(F.array(*[F.lit(w) for w in
                                                     ("train_1095", "serve_180", "serve_900")])).alias("frame"))
    out = grid.join(counts, ["ticker", "frame"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return out.select("ticker", "frame", n.alias("n_rows"),
                      F.when(n < config.MIN_FEATURE_ROWS, F.lit(config.INSUFFICIENT_DATA)).alias("error_code"))


def q_training_window(spark, sf):
    return train.training_window(fixture_prices(spark, sf), fixtures.AS_OF).select("ticker", "date", "close")


def q_training_window_years(spark, sf):
    """S1 from the two-level layout: the window of an earlier day, other years' folders unread."""
    name = f"prices_{uuid.uuid4().hex}"
    write_yearly_prices(fixture_prices(spark, sf), name, 8, path=f"{checkpoint_dir(spark)}/{name}")
    window = train.training_window(read_prices(spark, name, fmt="table"), fixtures.RUN1_AS_OF)
    return window.select("ticker", "date", "close")


def q_registry_look_up(spark, sf):
    """S7 in files: the requested keys' versions, read from their buckets."""
    root = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    reg = fixtures.registry(spark, sf)
    registry_store.append_models(reg.models, root)
    registry_store.append_tombstones(reg.tombstones, root)
    look = _lookups(reg.models.where((F.col("forecast_days") != 5) & (F.substring("ticker", 2, 9).try_cast("int") % 5 == 2)))
    g = registry.get(registry_store.read_models_of(spark, root, look), look, registry_store.read_tombstones(spark, root))
    return g.select("ticker", _i64("forecast_days").alias("forecast_days"), "last_trained_time", "status", "error_code", "version")


# --- W8 P6 P7 P8 P9 W9 W10 ------------------------------------------------------

def q_targets_multi_horizon(spark, sf):
    return _targets(spark, sf).select("ticker", _i64("forecast_days").alias("forecast_days"),
                                      "date", "price", "target")


def q_feature_slots(spark, sf):
    return _slots(spark, sf).select("ticker", _i64("forecast_days").alias("forecast_days"), "date",
                                    *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(4)], "y")


def q_last_fold_split(spark, sf):
    return _split(spark, sf).select("ticker", _i64("forecast_days").alias("forecast_days"), "date",
                                    _i64("i").alias("i"), _i64("n").alias("n"), "is_test")


def q_fold_intervals(spark, sf):
    """W10 without fan-out: which fold tests a row, and from which fold on it is trained on."""
    return split.fold_intervals(_slots(spark, sf)).select(
        "ticker", _i64("forecast_days").alias("forecast_days"), "date", _i64("i").alias("i"),
        _i64("test_fold").alias("test_fold"), _i64("first_train_fold").alias("first_train_fold"))


def q_all_folds_split(spark, sf):
    return split.all_folds(_slots(spark, sf)).select(
        "ticker", _i64("forecast_days").alias("forecast_days"), _i64("fold").alias("fold"),
        "date", _i64("i").alias("i"), "role")


# --- A3 T10 T11 A4-A9 B1 --------------------------------------------------------

def q_ols_moments(spark, sf):
    """Centred moments to 9 significant digits; first moments as exact sums
    (features and targets are 2-4 decimal values, so their decimal sums are
    exact, where a rounded mean can sit on a rounding tie)."""
    train_rows = _split(spark, sf).where(~F.col("is_test"))
    m = ols.moments(train_rows)
    exact = train_rows.groupBy("ticker", "forecast_days").agg(*[
        F.sum(F.round(c, 4).cast("decimal(18,4)")).cast("double").alias(f"s{c[1:] if c != 'y' else 'y'}")
        for c in ("x0", "x1", "x2", "x3", "y")])
    centred = [f"c{i}{j}" for i in range(4) for j in range(i, 4)] + [f"b{i}" for i in range(4)]
    return m.join(exact, ["ticker", "forecast_days"]).select(
        "ticker", _i64("forecast_days").alias("forecast_days"), _i64("n").alias("n"),
        *[F.format_string("%.8e", F.col(c)).alias(c) for c in centred],
        *[F.col(f"s{i}") for i in ("0", "1", "2", "3", "y")])


def q_ols_coefficients(spark, sf):
    return _coefficients(ols.fit(_split(spark, sf).where(~F.col("is_test"))))


def q_ols_incremental(spark, sf):
    """The same coefficients, carried from an earlier day to the year's end by moments."""
    tables = BookTables(spark, f"{checkpoint_dir(spark)}/book-{uuid.uuid4().hex}")
    prices = fixture_prices(spark, sf)
    first, *later = fixtures.BOOK_DAYS
    book = incremental.start(prices, first, fixtures.HORIZONS, tables)
    for day in later:
        book = incremental.advance(book, prices, day, tables)
    return _coefficients(incremental.models(book))


def _coefficients(fit: DataFrame) -> DataFrame:
    names = features.tier_features(F.col("forecast_days"))
    coefs = F.array(*[F.col(f"w{i}") for i in range(4)])
    pairs = F.arrays_zip(names.alias("feature"), F.slice(coefs, 1, F.size(names)).alias("value"))
    long = fit.select("ticker", "forecast_days", F.inline(
        F.concat(pairs, F.array(F.struct(F.lit("intercept").alias("feature"),
                                         F.col("intercept").alias("value"))))))
    return long.select("ticker", _i64("forecast_days").alias("forecast_days"), "feature",
                       F.when(F.col("feature") == "intercept", F.round("value", 2))
                       .otherwise(F.round("value", 6)).alias("coefficient"))


def _scored(spark, sf):
    s = _split(spark, sf)
    fit = ols.fit(s.where(~F.col("is_test")))
    return ols.predict(s.join(fit.drop("n"), ["ticker", "forecast_days"]))


def q_model_metrics(spark, sf):
    m = evaluate.evaluate(_scored(spark, sf))
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"), *_metric_projection(m))


def q_last_train_date(spark, sf):
    return (_split(spark, sf).groupBy("ticker", "forecast_days")
            .agg(F.max("date").alias("last_train_date"))
            .select("ticker", _i64("forecast_days").alias("forecast_days"), "last_train_date"))


def _model_projection(m: DataFrame) -> DataFrame:
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"), "model_type", "version",
                    _ts("trained_at").alias("trained_at"),
                    F.array_join("features", ",").alias("features"),
                    *[F.round(f"w{i}", 6).alias(f"w{i}") for i in range(4)],
                    F.round("intercept", 2).alias("intercept"), *_metric_projection(m), "last_train_date")


def q_train_all_models(spark, sf):
    return _model_projection(_year_end_models(spark, sf))


# --- B3 S2 S3 S4 S7 A10 A11 V8 T4 T5 T6 T9 ----------------------------------------

def q_registry_list(spark, sf):
    reg = fixtures.registry(spark, sf)
    m = registry.list_models(reg.models, reg.tombstones)
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"), "version",
                    _ts("trained_at").alias("trained_at"), F.round("mae", 2).alias("mae"),
                    F.round("r2", 6).alias("r2"), _i64("train_samples").alias("train_samples"),
                    _i64("test_samples").alias("test_samples"), "last_train_date")


def q_registry_count(spark, sf):
    reg = fixtures.registry(spark, sf)
    return registry.count_models(reg.models, reg.tombstones).select(_i64("count").alias("count"))


def q_registry_latest(spark, sf):
    reg = fixtures.registry(spark, sf)
    m = registry.latest(reg.models, reg.tombstones)
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"), "version",
                    _ts("trained_at").alias("trained_at"))


def _lookups(models: DataFrame, shift_seconds: int = 0) -> DataFrame:
    t = F.col("trained_at") + F.make_interval(secs=F.lit(shift_seconds)) if shift_seconds else F.col("trained_at")
    return models.select("ticker", "forecast_days", versions.api_datetime(t).alias("last_trained_time"))


def q_registry_get(spark, sf):
    reg = fixtures.registry(spark, sf)
    look = _lookups(reg.models).unionByName(
        _lookups(reg.models.where(F.col("forecast_days") == 5), 1))
    g = registry.get(reg.models, look, reg.tombstones)
    return g.select("ticker", _i64("forecast_days").alias("forecast_days"), "last_trained_time",
                    "status", "error_code", "version", F.round("mae", 2).alias("mae"))


def q_registry_delete(spark, sf):
    reg = fixtures.registry(spark, sf)
    r2 = reg.models.where(F.col("trained_at") == utc_instant(fixtures.RUN2_TRAINED_AT))
    look = _lookups(r2.where(F.col("forecast_days").isin(5, fixtures.DELETED_HORIZON)))
    _, outcome = registry.delete(reg.models, look, fixtures.DELETED_AT, reg.tombstones)
    return outcome.select("ticker", _i64("forecast_days").alias("forecast_days"), "last_trained_time",
                          "status", "error_code", "version")


def q_version_strings(spark, sf):
    reg = fixtures.registry(spark, sf)
    v = reg.models.select("version", "trained_at", "ticker", "forecast_days")
    parsed = versions.parse_version(F.col("version"))
    api = versions.api_datetime(F.col("trained_at"))
    return v.select(
        "version", parsed["ticker"].alias("parsed_ticker"),
        _i64(parsed["forecast_days"]).alias("parsed_forecast_days"),
        _ts(parsed["trained_at"]).alias("parsed_trained_at"),
        api.alias("api_datetime"),
        versions.api_datetime_to_version_time(api).alias("version_time"),
        versions.version_prefix(F.col("ticker"), F.col("forecast_days")).alias("prefix"),
        F.like(F.col("version"), versions.version_prefix(F.col("ticker"), F.col("forecast_days")))
        .alias("prefix_match"))


# --- J3 T8 B4 -----------------------------------------------------------------

def q_needs_training(spark, sf):
    reg = fixtures.registry(spark, sf)
    lat = registry.latest(reg.models, reg.tombstones)
    out = freshness.needs_training(fixtures.requests(spark, sf), lat, utc_instant(fixtures.NOW))
    return out.select("ticker", _i64("forecast_days").alias("forecast_days"), "version", "needs_training")


def q_skip_report(spark, sf):
    reg = fixtures.registry(spark, sf)
    lat = registry.latest(reg.models, reg.tombstones)
    s = freshness.skip_report(fixtures.requests(spark, sf), lat, utc_instant(fixtures.NOW))
    return s.select("ticker", _i64("forecast_days").alias("forecast_days"), "version", "status",
                    *_metric_projection(s), "last_train_date")


def q_needs_training_instants(spark, sf):
    """T8 before and after the close of a business day, on a weekend and on a holiday."""
    reg = fixtures.registry(spark, sf)
    lat = cut_lineage(registry.latest(reg.models, reg.tombstones))
    out = None
    for now in fixtures.INSTANTS:
        one = freshness.needs_training(fixtures.requests(spark, sf), lat, utc_instant(now)).select(
            F.lit(now).alias("now"), "ticker", _i64("forecast_days").alias("forecast_days"), "needs_training")
        out = one if out is None else out.unionByName(one)
    return out


def q_needs_training_calendars(spark, sf):
    """T8 by two calendars: requests name a country, sessions come from a table."""
    reg = fixtures.registry(spark, sf)
    lat = cut_lineage(registry.latest(reg.models, reg.tombstones))
    table = cut_lineage(sessions.sessions(fixtures.calendars(spark, sf)))
    out = None
    for now in fixtures.INSTANTS:
        one = freshness.needs_training(fixtures.with_country(fixtures.requests(spark, sf)), lat, utc_instant(now), table).select(
            F.lit(now).alias("now"), "country", "ticker", _i64("forecast_days").alias("forecast_days"), "needs_training")
        out = one if out is None else out.unionByName(one)
    return out


def q_next_sessions(spark, sf):
    """T2, T3 and J4 in join form, by two calendars."""
    latest = fixtures.with_country(fixture_prices(spark, sf).groupBy("ticker").agg(F.max("date").alias("latest_date")))
    table = sessions.sessions(fixtures.calendars(spark, sf))
    last = sessions.clocks(latest.select("country", F.col("latest_date").alias("today")), table).select(
        "country", F.col("today").alias("latest_date"), "last_business_day")
    days = sessions.next_sessions(latest, table, F.lit(30)).join(last, ["country", "latest_date"])
    return days.select("ticker", "country", "latest_date", "last_business_day", _i64("step").alias("step"), "date")


# --- corrupt versions; the registry in files ------------------------------------------

def q_registry_corrupt(spark, sf):
    """Newest version first, judged afterwards; what a forecast says about it."""
    reg = fixtures.registry(spark, sf)
    broken = ((F.col("trained_at") == utc_instant(fixtures.RUN2_TRAINED_AT)) & (F.col("forecast_days") == 30)
              & (F.substring("ticker", 2, 9).cast("int") % 3 == 0))
    models = reg.models.withColumn("intercept", F.when(~broken, F.col("intercept")))
    newest = cut_lineage(registry.latest(models, reg.tombstones))
    status = fplan.forecast_all(fixture_prices(spark, sf), fixtures.requests(spark, sf), newest, fixtures.AS_OF,
                                fixtures.HISTORY_DAYS).status
    return status.select("ticker", _i64("forecast_days").alias("forecast_days"), "version", "status", "error_code")


def q_registry_files(spark, sf):
    """Two training jobs, a delete and a snapshot in the shared folder, then the newest versions as read."""
    root = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    prices, req = fixture_prices(spark, sf), fixtures.requests(spark, sf)
    for as_of, now in ((fixtures.RUN1_AS_OF, fixtures.RUN1_TRAINED_AT), (fixtures.RUN2_AS_OF, fixtures.RUN2_TRAINED_AT)):
        jobs.run_training(spark, prices, req, root, as_of=as_of, now=datetime.fromisoformat(now), horizons=fixtures.HORIZONS)
    jobs.compact(spark, root)
    second = registry_store.read_models(spark, root).where(
        (F.col("trained_at") == utc_instant(fixtures.RUN2_TRAINED_AT)) & (F.col("forecast_days") == fixtures.DELETED_HORIZON))
    jobs.run_delete(spark, _lookups(second), root, deleted_at=datetime.fromisoformat(fixtures.DELETED_AT))
    m = jobs.latest_models(spark, root)
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"), "version",
                    _ts("trained_at").alias("trained_at"))


# --- rank-deficient fits ----------------------------------------------------------------

def _line_models(spark, sf):
    return train.train_all(fixtures.line_prices(spark, sf), fixtures.segment_requests(spark, sf), fixtures.AS_OF,
                           now=fixtures.NOW, horizons=fixtures.HORIZONS).models


def q_ols_collinear(spark, sf):
    """Series that rise by one a row: all centred features are equal."""
    m = _line_models(spark, sf)
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"),
                    *[F.round(f"w{i}", 6).alias(f"w{i}") for i in range(4)], F.round("intercept", 2).alias("intercept"))


def q_forecast_collinear(spark, sf):
    res = fplan.forecast_all(fixtures.line_prices(spark, sf), fixtures.segment_requests(spark, sf),
                             _line_models(spark, sf), fixtures.AS_OF, fixtures.HISTORY_DAYS)
    return res.forecasts.select("ticker", _i64("forecast_days").alias("forecast_days"), _i64("step").alias("step"),
                                "date", F.round("predicted_price", 2).alias("predicted_price"))


def q_daily_close(spark, sf):
    """Raw ticks reduced to the last price of the day."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("ticker"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("price"))
    ticks = e.withColumn("day", F.col("ts.ts"))
    return daily_close(ticks, day="day")


# --- T1 T2 T3 J4 ----------------------------------------------------------------

def q_business_calendar(spark, sf):
    cal = business_calendar.calendar_for(fixture_prices(spark, sf))
    return cal.select("date", _i64("weekday").alias("weekday"), "is_holiday", "is_business_day",
                      _i64("bd_index").alias("bd_index"))


def q_next_business_days(spark, sf):
    latest = fixture_prices(spark, sf).groupBy("ticker").agg(F.max("date").alias("latest_date"))
    days = latest.select("ticker", F.posexplode(calendar.next_business_days(F.col("latest_date"), 30))
                         .alias("pos", "date"))
    return days.select("ticker", (F.col("pos") + 1).cast("long").alias("step"), "date")


def q_last_business_day(spark, sf):
    d = fixture_prices(spark, sf).select("date").distinct()
    return d.select("date", calendar.last_business_day(F.col("date")).alias("last_business_day"))


# --- W12 P10 P13 O2 A13 R1 P11 W11 A12 R2 R3 J1 U1 B2 S5 ------------------------------

def q_history_tail(spark, sf):
    t = forecast.history_tail(fixture_prices(spark, sf), fixtures.HISTORY_DAYS, fixtures.AS_OF)
    return t.select("ticker", "date", "price", _i64("rn_desc").alias("rn_desc"), "latest_date",
                    _i64("n_hist").alias("n_hist"))


def q_serving_features(spark, sf):
    h = forecast.history_arrays(fixture_prices(spark, sf), fixtures.HISTORY_DAYS, fixtures.AS_OF)
    cols = forecast.serving_feature_columns(F.col("hist"))
    return h.select("ticker", _i64("n_hist").alias("n_hist"),
                    *[cols[c].alias(c) for c in LAG], *[F.round(cols[c], 6).alias(c) for c in MA])


def _models_with_history(spark, sf):
    return fplan.models_with_history(_year_end_models(spark, sf), fixture_prices(spark, sf),
                                     fixtures.HISTORY_DAYS, fixtures.AS_OF)


def q_single_prediction(spark, sf):
    p = forecast.single_prediction(_models_with_history(spark, sf))
    return p.select("ticker", _i64("forecast_days").alias("forecast_days"), "version", "date",
                    F.round("predicted_price", 2).alias("predicted_price"),
                    F.array_join("features_used", ",").alias("features_used"))


def q_predict_named(spark, sf):
    """Requests name the first run's versions (not the newest) and a date of their own."""
    reg = fixtures.registry(spark, sf)
    named = reg.models.where((F.col("trained_at") == utc_instant(fixtures.RUN1_TRAINED_AT)) & (F.col("forecast_days") == 30))
    req = named.select("ticker", "version", F.date_add(F.lit(fixtures.AS_OF).cast("date"), F.length("ticker")).alias("date"))
    p = fplan.predict_named(fixture_prices(spark, sf), reg.models, req, fixtures.HISTORY_DAYS, fixtures.AS_OF)
    return p.select("ticker", _i64("forecast_days").alias("forecast_days"), "version", "date",
                    F.round("predicted_price", 2).alias("predicted_price"),
                    F.array_join("features_used", ",").alias("features_used"))


def q_predict_named_status(spark, sf):
    """Named versions of which some are not stored, and some are incomplete: one row a request."""
    reg = fixtures.registry(spark, sf)
    number = F.substring("ticker", 2, 9).try_cast("int")
    models = reg.models.withColumn("intercept", F.when(number % 3 != 0, F.col("intercept")))
    named = reg.models.where((F.col("trained_at") == utc_instant(fixtures.RUN1_TRAINED_AT)) & (F.col("forecast_days") == 5))
    req = named.select("ticker", F.when(number % 4 == 1, F.concat("version", F.lit("0"))).otherwise(F.col("version")).alias("version"),
                       F.lit(fixtures.AS_OF).cast("date").alias("date"))
    p = fplan.predict_named(fixture_prices(spark, sf), models, req, fixtures.HISTORY_DAYS, fixtures.AS_OF)
    return p.select("ticker", "version", "date", "status", "error_code", F.round("predicted_price", 2).alias("predicted_price"))


def q_forecast_files(spark, sf):
    """Forecasts written by the jobs, one horizon read back."""
    root = f"{checkpoint_dir(spark)}/forecasts-{uuid.uuid4().hex}"
    prices, req = fixture_prices(spark, sf), fixtures.requests(spark, sf)
    jobs.run_training(spark, prices, req, f"{root}/registry", as_of=fixtures.AS_OF, now=datetime.fromisoformat(fixtures.NOW),
                      horizons=fixtures.HORIZONS)
    jobs.run_forecast(spark, prices, req, f"{root}/registry", f"{root}/out", as_of=fixtures.AS_OF, history_days=fixtures.HISTORY_DAYS)
    f = registry_store.read_forecasts(spark, f"{root}/out", horizons=[10])
    return f.select("ticker", _i64("forecast_days").alias("forecast_days"), _i64("step").alias("step"),
                    "date", F.round("predicted_price", 2).alias("predicted_price"))


def _forecasts(spark, sf):
    return fplan.forecast_all(fixture_prices(spark, sf), fixtures.requests(spark, sf),
                              _year_end_models(spark, sf), fixtures.AS_OF, fixtures.HISTORY_DAYS)


def q_recursive_forecast(spark, sf):
    f = _forecasts(spark, sf).forecasts
    return f.select("ticker", _i64("forecast_days").alias("forecast_days"), _i64("step").alias("step"),
                    "date", F.round("predicted_price", 2).alias("predicted_price"))


def q_history_plus_forecast(spark, sf):
    t = forecast.history_tail(fixture_prices(spark, sf), fixtures.HISTORY_DAYS, fixtures.AS_OF)
    u = fplan.history_plus_forecast(t, _forecasts(spark, sf).forecasts)
    return u.select("ticker", _i64("forecast_days").alias("forecast_days"), _i64("step").alias("step"),
                    "date", F.round("price", 2).alias("price"), "kind")


def q_forecast_all(spark, sf):
    res = _forecasts(spark, sf)
    per_key = res.forecasts.groupBy("ticker", "forecast_days").agg(
        F.count(F.lit(1)).alias("steps"), F.max("date").alias("last_date"))
    out = res.status.join(per_key, ["ticker", "forecast_days"], "left")
    return out.select("ticker", _i64("forecast_days").alias("forecast_days"), "status", "error_code",
                      _i64(F.coalesce(F.col("steps"), F.lit(0))).alias("steps"), "last_date")


# --- V1-V9 S6 B5 T12 ---------------------------------------------------------------

def quality_requests(spark, sf) -> DataFrame:
    """A request-shaped table derived from ``orders``: priorities as tickers
    (one is 15 characters), the price's integer part mod 400 as horizon,
    order dates as date / datetime strings with some malformed."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    d = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderpriority").alias("ticker"),
        (F.floor("o_totalprice").cast("long") % 400).alias("forecast_days"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.col("o_orderpriority")).alias("start_date"),
        F.date_format(F.date_add(d, ((F.col("o_orderkey") % 3) - 1).cast("int") * 30), "yyyy-MM-dd").alias("end_date"),
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd-HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("trained_time"),
        F.col("o_totalprice").alias("close"))


def q_quality_violations(spark, sf):
    r = quality_requests(spark, sf)
    rules = {
        "ticker": quality.bad_ticker(F.col("ticker")),
        "forecast_days": quality.bad_horizon(F.col("forecast_days")),
        "start_date": quality.bad_date_string(F.col("start_date")),
        "end_date": quality.bad_date_string(F.col("end_date")),
        "date_range": quality.bad_date_range(F.col("start_date"), F.col("end_date")),
        "trained_time": quality.bad_datetime_string(F.col("trained_time")),
        "close": quality.non_finite(F.col("close")),
    }
    v = quality.violations(rules)
    return r.select("request_id", F.array_join(v, ",").alias("violations"), (F.size(v) == 0).alias("valid"))


def q_price_quality(spark, sf):
    """Raw rows, as a source might deliver them: several a day, NaN and infinite
    closes, missing dates and tickers that are too long."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    raw = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"),
                 F.when(F.col("l_suppkey") % 4 == 0, F.lit("-LONG-NAME")).otherwise(F.lit(""))).alias("ticker"),
        F.when(F.col("l_linenumber") < 6, F.to_date("l_shipdate")).alias("date"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_discount") == 0, F.lit(float("inf")))
        .otherwise(F.col("l_extendedprice")).alias("close"))
    r = quality.price_table_report(raw)
    return r.select("ticker", *[_i64(c).alias(c) for c in ("n_rows", "n_duplicate_days", "n_bad_close",
                                                           "n_null_date")], "bad_ticker")


def _guarded_prices(spark, sf) -> DataFrame:
    """Fixture prices with NaN closes in some series, and rows that repeat a day in others."""
    p = fixture_prices(spark, sf)
    number = F.substring("ticker", 2, 9).cast("int")
    late = F.col("date") >= F.lit("2001-06-01").cast("date")
    spoiled = p.withColumn("close", F.when((number % 5 == 0) & late & (F.dayofmonth("date") == 13), F.lit(float("nan")))
                           .otherwise(F.col("close")))
    again = p.where((number % 7 == 3) & late & (F.dayofmonth("date") == 21))
    return spoiled.unionByName(again)


def q_row_guards(spark, sf):
    req = fixtures.requests(spark, sf)
    keyed = train.fit_and_score(train.split_rows(train.training_window(_guarded_prices(spark, sf), fixtures.AS_OF),
                                                 fixtures.HORIZONS, train.requested_horizons(req)))
    out = req.join(keyed, ["ticker", "forecast_days"], "left")
    code, _ = train.outcome()
    few = features.build_features(fixture_prices(spark, sf)).drop("lag5", "ma20")  # V6: schema metadata only
    return out.select(
        "ticker", _i64("forecast_days").alias("forecast_days"),
        _i64(F.coalesce("n_feat", F.lit(0))).alias("n_feature_rows"),
        _i64(F.coalesce("n", F.lit(0))).alias("n_xy"), _i64(F.coalesce("n_bad", F.lit(0))).alias("n_bad"),
        _i64(F.coalesce("n_dup", F.lit(0))).alias("n_dup"),
        code.alias("error_code"), F.lit(",".join(missing_columns(few))).alias("missing_columns"))


def q_run_log(spark, sf):
    reg = fixtures.registry(spark, sf)
    lat = registry.latest(reg.models, reg.tombstones)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    extra = o.select(F.col("o_orderpriority").alias("ticker"), F.lit(5).alias("forecast_days")).distinct()
    req = fixtures.requests(spark, sf).unionByName(extra)
    res = train.train_all(fixture_prices(spark, sf), req, fixtures.AS_OF, now=fixtures.NOW,
                          latest_models=lat, horizons=fixtures.HORIZONS)
    return res.run_log.select("ticker", _i64("forecast_days").alias("forecast_days"), "status",
                              "error_code", "version")


def q_model_card(spark, sf):
    m = report.metrics_labels(_year_end_models(spark, sf))
    return m.select("ticker", _i64("forecast_days").alias("forecast_days"), "version", "mae_label", "r2_label",
                    "mape_label", "max_ae_label", _i64("train_samples").alias("train_samples"),
                    _i64("test_samples").alias("test_samples"))


def q_forecast_report(spark, sf):
    models = _year_end_models(spark, sf)
    f = _forecasts(spark, sf).forecasts
    return report.forecast_report(f, models)


# --- second and third sources: hot keys through a join, short histories -------------

def _segment_models(spark, sf):
    return train.train_all(fixtures.segment_prices(spark, sf), fixtures.segment_requests(spark, sf),
                           fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS).models


def q_segment_models(spark, sf):
    return _model_projection(_segment_models(spark, sf))


def q_segment_forecast(spark, sf):
    res = fplan.forecast_all(fixtures.segment_prices(spark, sf), fixtures.segment_requests(spark, sf),
                             _segment_models(spark, sf), fixtures.AS_OF, fixtures.HISTORY_DAYS)
    return res.forecasts.select("ticker", _i64("forecast_days").alias("forecast_days"), _i64("step").alias("step"),
                                "date", F.round("predicted_price", 2).alias("predicted_price"))


def q_event_run_log(spark, sf):
    prices = fixtures.event_prices(spark, sf)
    req = prices.select("ticker").distinct().select("ticker", F.lit(5).alias("forecast_days"))
    res = train.train_all(prices, req, fixtures.EVENTS_AS_OF, now=fixtures.EVENTS_NOW, horizons=[5],
                          materialize=None)
    days = prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_days"))
    rows = train.split_rows(train.training_window(prices, fixtures.EVENTS_AS_OF), [5],
                            train.requested_horizons(req))
    feats = rows.groupBy("ticker").agg(F.max("n_feat").alias("n_feat"))
    log = res.run_log.join(feats, "ticker", "left").join(days, "ticker", "left")
    return log.select("ticker", _i64("forecast_days").alias("forecast_days"), "status", "error_code",
                      _i64(F.coalesce("n_feat", F.lit(0))).alias("n_feature_rows"), _i64("n_days").alias("n_days"))


def _utc_session(fn):
    """Timestamps render in the session zone; the catalog pins it to UTC."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ensure_utc(spark)
        return fn(spark, sf)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _utc_session(fn) for name, fn in _QUERIES.items()}


_QUERIES = {
    "features": q_features,
    "features_in_range": q_features_in_range,
    "features_one_series": q_features_one_series,
    "targets_one_series": q_targets_one_series,
    "latest_date": q_latest_date,
    "sufficiency_guard": q_sufficiency_guard,
    "training_window": q_training_window,
    "training_window_years": q_training_window_years,
    "registry_look_up": q_registry_look_up,
    "targets_multi_horizon": q_targets_multi_horizon,
    "feature_slots": q_feature_slots,
    "last_fold_split": q_last_fold_split,
    "all_folds_split": q_all_folds_split,
    "fold_intervals": q_fold_intervals,
    "ols_moments": q_ols_moments,
    "ols_coefficients": q_ols_coefficients,
    "ols_incremental": q_ols_incremental,
    "model_metrics": q_model_metrics,
    "last_train_date": q_last_train_date,
    "train_all_models": q_train_all_models,
    "registry_list": q_registry_list,
    "registry_count": q_registry_count,
    "registry_latest": q_registry_latest,
    "registry_get": q_registry_get,
    "registry_delete": q_registry_delete,
    "version_strings": q_version_strings,
    "needs_training": q_needs_training,
    "skip_report": q_skip_report,
    "needs_training_calendars": q_needs_training_calendars,
    "next_sessions": q_next_sessions,
    "business_calendar": q_business_calendar,
    "next_business_days": q_next_business_days,
    "last_business_day": q_last_business_day,
    "history_tail": q_history_tail,
    "serving_features": q_serving_features,
    "single_prediction": q_single_prediction,
    "recursive_forecast": q_recursive_forecast,
    "history_plus_forecast": q_history_plus_forecast,
    "forecast_all": q_forecast_all,
    "quality_violations": q_quality_violations,
    "row_guards": q_row_guards,
    "price_quality": q_price_quality,
    "run_log": q_run_log,
    "forecast_report": q_forecast_report,
    "model_card": q_model_card,
    "segment_models": q_segment_models,
    "segment_forecast": q_segment_forecast,
    "event_run_log": q_event_run_log,
    "needs_training_instants": q_needs_training_instants,
    "registry_corrupt": q_registry_corrupt,
    "registry_files": q_registry_files,
    "ols_collinear": q_ols_collinear,
    "forecast_collinear": q_forecast_collinear,
    "predict_named": q_predict_named,
    "predict_named_status": q_predict_named_status,
    "forecast_files": q_forecast_files,
    "daily_close": q_daily_close,
}
