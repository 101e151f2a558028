import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tidecast.operators import ols, split
from tidecast.plans import train
from tidecast.sources import fixtures
from tidecast.sources.prices import fixture_prices


def sk_last_fold(n, n_splits):
    """TimeSeriesSplit's last fold, written from its documented definition."""
    if n_splits + 1 > n:
        raise ValueError
    ts = n // (n_splits + 1)
    start = n - ts
    return list(range(0, start)), list(range(start, n))


def sk_folds(n, n_splits):
    ts = n // (n_splits + 1)
    out = []
    for s in range(n - n_splits * ts, n, ts):
        out.append((list(range(0, s)), list(range(s, s + ts))))
    return out


@pytest.mark.parametrize("test_size,expected", [(0.2, 5), (0.5, 2), (0.3, 3), (0.9, 2)])
def test_n_splits(test_size, expected):
    assert split.n_splits_for(test_size) == expected


@pytest.mark.parametrize("bad", [-0.1, 0, 1, 1.1])
def test_test_size_bounds(bad):
    with pytest.raises(ValueError):
        split.n_splits_for(bad)


def test_test_size_type():
    with pytest.raises(TypeError):
        split.n_splits_for("0.2")


def _day(i):
    from datetime import date, timedelta
    return (date(2020, 1, 1) + timedelta(days=i)).isoformat()


def _numbered(spark, n):
    rows = [("A", 5, _day(i)) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, forecast_days int, date string").withColumn(
        "date", F.to_date("date"))


@pytest.mark.parametrize("n", [6, 7, 11, 12, 31])
def test_last_fold_matches_definition(spark, n):
    out = split.last_fold(_numbered(spark, n)).orderBy("date").collect()
    train_idx, test_idx = sk_last_fold(n, 5)
    assert [i for i, r in enumerate(out) if r.is_test] == test_idx
    assert [i for i, r in enumerate(out) if not r.is_test] == train_idx


def test_too_few_rows_cannot_split(spark):
    out = split.last_fold(_numbered(spark, 5)).collect()
    assert all(r.is_test is None for r in out)


@pytest.mark.parametrize("n", [6, 13, 40])
def test_all_folds_match_definition(spark, n):
    out = split.all_folds(_numbered(spark, n)).collect()
    for f, (tr, te) in enumerate(sk_folds(n, 5), start=1):
        got_tr = sorted(r.i - 1 for r in out if r.fold == f and r.role == "train")
        got_te = sorted(r.i - 1 for r in out if r.fold == f and r.role == "test")
        assert got_tr == tr and got_te == te


def _numpy_fit(X, y):
    A = np.column_stack([X, np.ones(len(X))])
    coef, *_ = np.linalg.lstsq(A, y, rcond=None)
    return coef[:-1], coef[-1]


def test_fit_and_metrics_match_numpy(spark):
    prices = fixture_prices(spark, SF001)
    rows = train.split_rows(train.training_window(prices, fixtures.AS_OF), [5, 10, 30])
    keyed = train.fit_and_score(rows).toPandas()
    pdf = rows.where("valid").toPandas()
    checked = 0
    for (t, h), g in pdf.groupby(["ticker", "forecast_days"]):
        g = g.sort_values("date")
        nfeat = 3 if h > 20 else 4
        X = g[[f"x{i}" for i in range(nfeat)]].to_numpy()
        y = g["y"].to_numpy()
        tr, te = sk_last_fold(len(g), 5)
        w, b = _numpy_fit(X[tr], y[tr])
        yhat = X[te] @ w + b
        err = np.abs(y[te] - yhat)
        k = keyed[(keyed.ticker == t) & (keyed.forecast_days == h)].iloc[0]
        got_w = np.array([k[f"w{i}"] for i in range(nfeat)])
        assert np.allclose(got_w, w, rtol=1e-8, atol=1e-10)
        assert abs(k.intercept - b) <= 1e-8 * max(1.0, abs(b))
        if h > 20:
            assert k.w3 == 0.0
        assert abs(k.mae - err.mean()) < 1e-6
        assert abs(k.max_ae - err.max()) < 1e-6
        assert abs(k.mape - (err / np.maximum(np.abs(y[te]), np.finfo(float).eps)).mean()) < 1e-9
        sst = ((y[te] - y[te].mean()) ** 2).sum()
        assert abs(k.r2 - (1 - (err ** 2).sum() / sst)) < 1e-9
        assert k.train_samples == len(tr) and k.test_samples == len(te)
        assert k.last_train_date == g.date.max()
        checked += 1
    assert checked == 30


def test_constant_series_gives_mean_and_zero_slopes(spark):
    rows = [("C", 5, _day(i), 7.0, 7.0, 7.0, 7.0, 7.0) for i in range(12)]
    df = spark.createDataFrame(rows, "ticker string, forecast_days int, date string, "
                                     "x0 double, x1 double, x2 double, x3 double, y double")
    fit = ols.fit(df).first()
    assert (fit.w0, fit.w1, fit.w2, fit.w3) == (0.0, 0.0, 0.0, 0.0)
    assert fit.intercept == 7.0


def test_collinear_slots_get_the_least_norm_solution(spark):
    # x1 = 2 * x0 exactly: the second pivot vanishes, fitted values still exact
    rows = [("C", 5, _day(i), float(i), 2.0 * i, float(i * i % 7), 0.0, 3.0 + 2.0 * i)
            for i in range(20)]
    df = spark.createDataFrame(rows, "ticker string, forecast_days int, date string, "
                                     "x0 double, x1 double, x2 double, x3 double, y double")
    fit = ols.predict(df.join(ols.fit(df).drop("n"), ["ticker", "forecast_days"])).toPandas()
    assert np.allclose(fit.yhat, fit.y, atol=1e-9)
    w = fit[["w0", "w1", "w2", "w3"]].iloc[0].to_numpy()
    x = np.array([r[3:7] for r in rows])
    y = np.array([r[7] for r in rows])
    want = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-12)[0]
    assert np.allclose(w, want, atol=1e-9) and w[3] == 0.0


@pytest.mark.parametrize("kind", ["line", "all_equal", "constant", "two_pairs", "few_rows"])
def test_rank_deficient_fits_match_lstsq(spark, kind):
    t = np.arange(3 if kind == "few_rows" else 24, dtype=float)
    rng = np.random.default_rng(1)
    wave = np.sin(t) * 3 + t % 5
    x = {"line": np.stack([150 + t - k for k in (0, 1, 5, 20)], 1), "all_equal": np.stack([wave] * 4, 1),
         "constant": np.stack([np.full_like(t, 7.0)] * 4, 1),
         "two_pairs": np.stack([wave, 2 * wave - 1, t, 3 * t + 4], 1),
         "few_rows": rng.normal(size=(3, 4))}[kind]
    y = 5 + x @ np.array([0.5, -1.0, 2.0, 0.25]) + rng.normal(size=len(t))
    rows = [("C", 5, _day(i), *map(float, x[i]), float(y[i])) for i in range(len(t))]
    df = spark.createDataFrame(rows, "ticker string, forecast_days int, date string, "
                                     "x0 double, x1 double, x2 double, x3 double, y double")
    [fit] = ols.fit(df).collect()
    want = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-9)[0]
    assert np.allclose([fit.w0, fit.w1, fit.w2, fit.w3], want, atol=1e-7)
    assert fit.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-6)

