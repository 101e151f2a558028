"""Train every requested (ticker, horizon) in one lazy plan.

Plan shape (see ``explain``): the requested-ticker join shuffles prices by
``ticker`` once; the feature window, the target window, the split windows
over ``(ticker, forecast_days)``, the moment aggregate, the join of rows with
their ticker's models and the metrics aggregate all reuse that partitioning
(local sorts only).  Nothing is
collected except the list of distinct horizons (at most ``MAX_HORIZON``
integers, needed to lay out the ``lead`` columns).  Jobs and queries run the
same plan: the request table is always joined.
"""

from __future__ import annotations

from collections import namedtuple
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .. import outcomes as texts
from ..functions import quality, versions
from ..functions.instants import utc_instant
from ..operators import evaluate, features, freshness, ols, split
from ..sources.prices import in_range

KEYS = ("ticker", "forecast_days")

TrainResult = namedtuple("TrainResult", ["models", "run_log"])


def _date(v) -> Column:
    return v if isinstance(v, Column) else F.to_date(F.lit(str(v)))


def _instant(v) -> Column:
    return utc_instant(v)


def training_window(prices: DataFrame, as_of, lookback_days: int = config.TRAIN_LOOKBACK_DAYS) -> DataFrame:
    """P10 + P12 + T7: ``as_of - lookback_days <= date <= as_of``.

    With the data cut at ``as_of`` the upper bound equals each series'
    latest date (A1), as the service used.  Both bounds sit below the
    windows and reach the scan as pushed filters.
    """
    d = _date(as_of)
    return in_range(prices, F.date_sub(d, lookback_days), d)


def requested_horizons(requests: DataFrame) -> DataFrame:
    """``(ticker, horizons array<int>)``; at most ``MAX_HORIZON`` values per ticker."""
    return requests.groupBy("ticker").agg(F.collect_set("forecast_days").alias("horizons"))


def distinct_horizons(requests: DataFrame) -> list[int]:
    # validated horizons lie in 1..MAX_HORIZON, so this is at most 365 integers
    rows = (requests.select(F.col("forecast_days").cast("int").alias("h"))
            .where(F.col("h").between(1, config.MAX_HORIZON)).distinct().collect())
    return sorted(r.h for r in rows)


def split_rows(prices: DataFrame, horizons, requested: DataFrame | None = None,
               test_size: float = config.DEFAULT_TEST_SIZE) -> DataFrame:
    """Feature rows x horizons with slots ``x0..x3``, target ``y`` and the
    last-fold flag.  Invalid rows (a null anywhere) are kept with
    ``is_test = null`` so every key keeps its counts for the run log."""
    k = split.n_splits_for(test_size)
    base = prices if requested is None else prices.join(requested, "ticker", "inner")
    carry = ("horizons", "n_dup") if requested is not None else ("n_dup",)
    feats = features.build_features(features.count_repeated_days(base), carry=carry)
    long = features.add_targets(feats, horizons, keep_invalid=True)
    fd = F.col("forecast_days")
    slotted = long.select(
        "ticker", "forecast_days", "date", "valid", "n_dup",
        *features.slot_columns(fd, F.col), F.col("target").alias("y"))
    # One window node: running and whole-key counts share the (key, date) sort.
    wk = Window.partitionBy(*KEYS).orderBy("date")
    whole = wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col("valid").cast("int")
    numbered = slotted.withColumns({
        "i": F.sum(v).over(wk.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.sum(v).over(whole),
        "n_feat": F.count(F.lit(1)).over(whole),  # feature rows of the ticker
    })
    n_test = F.floor(F.col("n") / F.lit(k + 1))
    return numbered.withColumn(
        "is_test", F.when(F.col("valid") & (F.col("n") > k), F.col("i") > F.col("n") - n_test))


def fit_and_score(rows: DataFrame) -> DataFrame:
    """A3-A9 per key: coefficients fitted on train rows, metrics on test rows,
    plus counts the run log needs (``n_feat``, ``n``, ``n_bad``).

    Two passes over the rows behind one price exchange: the moments of the train rows are
    reduced and solved on one row a key, then every row meets its ticker's models and one
    aggregate makes the counts and the errors."""
    models = ols.fit(rows.where(~F.col("is_test")))
    return _score(ols.predict(ols.with_model(rows, models)))


def _score(fitted: DataFrame) -> DataFrame:
    """Per-key aggregate of scored rows (one hash aggregate, no sort)."""
    bad = F.lit(False)
    for c in ("x0", "x1", "x2", "x3", "y"):
        bad = bad | quality.non_finite(F.col(c))
    return fitted.groupBy(*KEYS).agg(
        F.max("n_feat").alias("n_feat"),
        F.max("n").alias("n"),
        F.max("n_dup").alias("n_dup"),
        F.count_if(F.col("valid") & bad).alias("n_bad"),
        *[F.max(f"w{i}").alias(f"w{i}") for i in range(config.N_SLOTS)],
        F.max("intercept").alias("intercept"),
        *evaluate.metric_aggregates(F.col("y"), F.col("yhat"), F.col("is_test")),
        F.max(F.when(F.col("valid"), F.col("date"))).alias("last_train_date"),
    )


def model_columns(df: DataFrame, trained_at: Column) -> DataFrame:
    """Shape fitted keys as registry rows (``schema.MODEL``)."""
    fd = F.col("forecast_days")
    names = features.tier_features(fd)
    coefs = F.slice(F.array(*[F.col(f"w{i}") for i in range(config.N_SLOTS)]), 1, F.size(names))
    return df.select(
        "ticker", fd.cast("int").alias("forecast_days"),
        F.lit(config.MODEL_TYPE).alias("model_type"),
        versions.version_string(F.col("ticker"), fd, trained_at).alias("version"),
        trained_at.alias("trained_at"),
        names.alias("features"),
        F.map_from_arrays(names, coefs).alias("coefficients"),
        *[F.col(f"w{i}") for i in range(config.N_SLOTS)],
        "intercept", "mae", "r2", "mape", "max_ae",
        "train_samples", "test_samples", "last_train_date")


def outcome(test_size: float = config.DEFAULT_TEST_SIZE) -> tuple[Column, Column]:
    """``(error_code, error)`` for a request joined to its key counts."""
    k = split.n_splits_for(test_size)
    n_feat = F.coalesce(F.col("n_feat"), F.lit(0))
    n = F.coalesce(F.col("n"), F.lit(0))
    code = (F.when(F.col("n_dup") > 0, F.lit(config.DUPLICATE_DAYS))
            .when(n_feat < config.MIN_FEATURE_ROWS, F.lit(config.INSUFFICIENT_DATA))
            .when(n <= k, F.lit(config.TRAINING_FAILED))
            .when(F.col("n_bad") > 0, F.lit(config.TRAINING_FAILED)))
    msg = (F.when(F.col("n_dup") > 0, texts.several_rows_a_day(F.col("n_dup")))
           .when(n_feat < config.MIN_FEATURE_ROWS, texts.too_short(F.col("ticker"), n_feat))
           .when(n == 0, texts.no_training_rows())
           .when(n <= k, texts.too_few_for_folds(n, k))
           .when(F.col("n_bad") > 0, texts.not_finite()))
    return code, msg


def train_all(prices: DataFrame, requests: DataFrame, as_of, now=None,
              latest_models: DataFrame | None = None, horizons=None,
              test_size: float = config.DEFAULT_TEST_SIZE,
              lookback_days: int = config.TRAIN_LOOKBACK_DAYS,
              materialize=None, max_horizon: int = config.MAX_HORIZON,
              market_sessions: DataFrame | None = None) -> TrainResult:
    """B1: validate -> staleness -> window -> features -> split -> fit ->
    metrics, for all requests at once.

    ``requests``: ``(ticker, forecast_days)``.  ``as_of``: the data cut-off
    date ("today" of the run).  ``now``: the run instant (staleness check and
    ``trained_at``), default the driver clock.  ``latest_models``: the
    registry's latest versions (A10) for the staleness check, or None.
    ``materialize``: optional ``DataFrame -> DataFrame`` applied to the
    per-request outcome table before it fans out into ``models`` and
    ``run_log`` (a job passes a reliable checkpoint so that writing both
    does not run the training plan twice).  ``max_horizon``: the largest
    horizon that a valid request may name.  ``market_sessions``: sessions of another
    calendar than the built-in one, for the staleness check.

    Returns lazy ``models`` (registry rows) and ``run_log`` (one row per
    request: completed / skipped / failed with an error code).
    """
    now_c = _instant(now if now is not None else datetime.now(timezone.utc).replace(microsecond=0))
    req = requests.select(F.col("ticker"), F.col("forecast_days"))
    clean, rejected = quality.split_valid(req, quality.request_rules(max_horizon=max_horizon))
    rejected = rejected.withColumns({"code": F.lit(config.INVALID_REQUEST), "why": texts.invalid(F.col("violations"))})
    clean = clean.select("ticker", F.col("forecast_days").cast("int").alias("forecast_days")).distinct()
    if horizons is not None:  # a job laid out for fixed horizons rejects the others
        listed = F.col("forecast_days").isin([int(h) for h in horizons])
        unlisted = clean.where(~listed).withColumns({"code": F.lit(config.HORIZON_NOT_LISTED), "why": texts.not_listed()})
        rejected = rejected.drop("violations").unionByName(unlisted)
        clean = clean.where(listed)
    # staleness is decided once: the outcome table below carries it, so a
    # job that appends to the registry never re-reads it for the run log
    checked = freshness.needs_training(clean, latest_models, now_c, market_sessions)
    if materialize is not None:  # one row per request: cheap to pin down first
        checked = materialize(checked)
    stale = checked.where(F.col("needs_training")).select(*KEYS)

    hs = distinct_horizons(stale) if horizons is None else sorted({int(h) for h in horizons})
    if materialize is not None and hs and stale.isEmpty():
        hs = []  # every request is fresh: no price plan at all
    window = training_window(prices, as_of, lookback_days)
    code, msg = outcome(test_size)
    if hs:
        keyed = fit_and_score(split_rows(window, hs, requested_horizons(stale), test_size))
        # one outcome row per clean request: a single pass over the training plan
        outcomes = checked.join(keyed, list(KEYS), "left")
    else:  # nothing to fit: same columns, all null
        nulls = {c: "long" for c in ("n_feat", "n", "n_dup", "n_bad", "train_samples", "test_samples")}
        nulls.update({c: "double" for c in ("w0", "w1", "w2", "w3", "intercept", "mae", "r2", "mape", "max_ae")})
        nulls["last_train_date"] = "date"
        outcomes = checked.withColumns({c: F.lit(None).cast(t) for c, t in nulls.items()})
    stale_c = F.col("needs_training")
    outcomes = outcomes.withColumns({
        "error_code": F.when(stale_c, code),
        "error": F.when(stale_c, msg).otherwise(texts.fresh()),
    })
    if materialize is not None:
        outcomes = materialize(outcomes)
    done = outcomes.where(stale_c & F.col("error_code").isNull())
    models = model_columns(done, now_c)

    status = (F.when(~stale_c, F.lit(config.STATUS_SKIPPED))
              .when(F.col("error_code").isNull(), F.lit(config.STATUS_COMPLETED))
              .otherwise(F.lit(config.STATUS_FAILED)))
    completed = stale_c & F.col("error_code").isNull()
    run_log = outcomes.select(
        *KEYS, status.alias("status"), "error_code", "error",
        F.when(~stale_c, F.col("version"))
        .when(completed, versions.version_string(F.col("ticker"), F.col("forecast_days"), now_c))
        .alias("version"),
        F.when(~stale_c, F.col("trained_at")).when(completed, now_c).alias("trained_at"))
    rejected_log = rejected.select(
        "ticker", F.col("forecast_days").try_cast("int").alias("forecast_days"),
        F.lit(config.STATUS_FAILED).alias("status"), F.col("code").alias("error_code"), F.col("why").alias("error"),
        F.lit(None).cast("string").alias("version"), F.lit(None).cast("timestamp").alias("trained_at"))
    run_log = run_log.unionByName(rejected_log)
    return TrainResult(models, run_log)
