"""Property tests: random series, several per Spark job, against plain Python."""

from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast import config
from tidecast.operators import features, forecast

prices = st.lists(st.integers(min_value=100, max_value=99999).map(lambda c: c / 100.0), min_size=95, max_size=160)
series_sets = st.lists(prices, min_size=1, max_size=4)


def _frame(spark, sets):
    rows = []
    for s, vals in enumerate(sets):
        start = date(2020, 1, 1) + timedelta(days=s)
        rows += [(f"T{s}", start + timedelta(days=i), v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def _py_features(vals):
    out = []
    for i in range(100, len(vals)):
        out.append((vals[i], vals[i - 1], vals[i - 5], vals[i - 20], vals[i - 100],
                    sum(vals[i - 4:i + 1]) / 5, sum(vals[i - 19:i + 1]) / 20, sum(vals[i - 99:i + 1]) / 100))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series_sets)
def test_features_match_python(spark, sets):
    got = features.build_features(_frame(spark, sets)).orderBy("ticker", "date").collect()
    exp = []
    for vals in sets:
        exp += _py_features(vals)
    assert len(got) == len(exp)
    for r, e in zip(got, exp):
        assert (r.price, r.lag1, r.lag5, r.lag20, r.lag100) == e[:5]
        assert all(abs(a - b) < 1e-9 * max(1.0, abs(b)) for a, b in zip((r.ma5, r.ma20, r.ma100), e[5:]))


def _py_forecast(hist, h, w, b):
    work = list(hist)
    names = (config.SHORT_TERM_FEATURES if h <= 5 else config.MEDIUM_TERM_FEATURES if h <= 20
             else config.LONG_TERM_FEATURES)
    out = []
    for _ in range(h):
        tail = work[-100:]

        def feat(n):
            k = int(n[3:]) if n.startswith("lag") else int(n[2:])
            last = tail[-k:]
            return last[0] if n.startswith("lag") else sum(last) / len(last)
        p = b + sum(w[i] * feat(n) for i, n in enumerate(names))
        out.append(p)
        work.append(p)
    return out


model = st.tuples(st.lists(st.integers(100, 99999).map(lambda c: c / 100.0), min_size=1, max_size=130),
                  st.integers(1, 40),
                  st.lists(st.floats(-0.6, 0.6, allow_nan=False), min_size=4, max_size=4),
                  st.floats(-100, 100, allow_nan=False))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(model, min_size=1, max_size=5))
def test_recursion_matches_python(spark, models):
    rows = [(f"T{i}", h, date(2021, 3, 1), hist, *w, b) for i, (hist, h, w, b) in enumerate(models)]
    df = spark.createDataFrame(rows, "ticker string, forecast_days int, latest_date date, hist array<double>, "
                                     "w0 double, w1 double, w2 double, w3 double, intercept double")
    got = forecast.recursive_forecast(df).orderBy("ticker", "step").collect()
    for i, (hist, h, w, b) in enumerate(models):
        mine = [r.predicted_price for r in got if r.ticker == f"T{i}"]
        exp = _py_forecast(hist, h, w, b)
        assert len(mine) == h
        assert all(abs(a - e) <= 1e-9 * max(1.0, abs(e)) for a, e in zip(mine, exp))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dates(min_value=date(1990, 1, 1), max_value=date(2040, 12, 31)), min_size=1, max_size=20),
       st.integers(1, 60))
def test_next_business_days_are_the_first_n_after(spark, days, n):
    from tidecast.functions import calendar
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", calendar.next_business_days(F.col("d"), n).alias("nb"),
                    calendar.last_business_day(F.col("d")).alias("lb")).collect()
    span = spark.createDataFrame([(min(days) - timedelta(days=15), max(days) + timedelta(days=2 * n + 20))],
                                 "start date, end date")
    from tidecast.operators import business_calendar
    bd = sorted(r.date for r in business_calendar.calendar_between(span).where("is_business_day").collect())
    for r in got:
        after = [x for x in bd if x > r.d][:n]
        before = [x for x in bd if x < r.d]
        assert r.nb == after
        assert r.lb == before[-1]


def _py_bad(s, fmt):
    from datetime import datetime
    try:
        datetime.strptime(s, fmt)
        return False
    except ValueError:
        return True


date_like = st.one_of(
    st.text(alphabet="0123456789-", min_size=0, max_size=12),
    st.builds(lambda y, m, d: f"{y}-{m}-{d}", st.integers(0, 9999).map(lambda y: f"{y:04d}"),
              st.integers(0, 13).map(str) | st.integers(0, 13).map(lambda m: f"{m:02d}"),
              st.integers(0, 32).map(str) | st.integers(0, 32).map(lambda d: f"{d:02d}")))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(date_like, min_size=20, max_size=60))
def test_date_rule_agrees_with_strptime(spark, values):
    from tidecast.functions import quality
    values = [v for v in values if not v.startswith("0000")]  # year 0 is outside Python's range
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.b for r in df.select(quality.bad_date_string(F.col("s")).alias("b")).collect()]
    assert got == [_py_bad(v, "%Y-%m-%d") for v in values]


datetime_like = st.builds(
    lambda d, h, mi, s: f"{d}-{h}:{mi}:{s}",
    st.builds(lambda y, m, d: f"{y:04d}-{m:02d}-{d:02d}", st.integers(1990, 2030), st.integers(1, 12), st.integers(1, 28)),
    st.integers(0, 25).map(str), st.integers(0, 61).map(str), st.integers(0, 61).map(lambda x: f"{x:02d}"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(datetime_like, min_size=20, max_size=60))
def test_datetime_rule_agrees_with_strptime(spark, values):
    from tidecast.functions import quality
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.b for r in df.select(quality.bad_datetime_string(F.col("s")).alias("b")).collect()]
    assert got == [_py_bad(v, "%Y-%m-%d-%H:%M:%S") for v in values]


versions_st = st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.sampled_from([5, 10]),
                                 st.integers(0, 50), st.booleans(), st.booleans()),
                       min_size=1, max_size=25, unique_by=lambda t: (t[0], t[1], t[2]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(versions_st)
def test_latest_with_tombstones_matches_python(spark, rows):
    """rows: (ticker, horizon, minute offset, deleted?, complete?)"""
    from datetime import datetime, timedelta
    from tidecast import schema
    from tidecast.operators import registry
    base = datetime(2023, 1, 2, 15, 0)
    models, tombs = [], []
    for t, h, m, deleted, complete in rows:
        at = base + timedelta(minutes=m)
        models.append((t, h, "LinearRegression", f"{t}-{h}-{m}", at, ["lag1"], {"lag1": 0.1}, 0.1, 0.0, 0.0, 0.0,
                       1.0 if complete else None, 1.0, 0.5, 0.1, 2.0, 10, 2, date(2023, 1, 1)))
        if deleted:
            tombs.append((t, h, at, base + timedelta(days=1)))
    mdf = spark.createDataFrame(models, schema.MODEL)
    tdf = spark.createDataFrame(tombs, schema.TOMBSTONE)
    got = {(r.ticker, r.forecast_days): r.version for r in registry.latest(mdf, tdf).collect()}
    exp = {}
    for t, h, m, deleted, complete in rows:
        if deleted:  # an incomplete newest version stays: it is judged after it is chosen
            continue
        if (t, h) not in exp or m > exp[(t, h)][0]:
            exp[(t, h)] = (m, f"{t}-{h}-{m}")
    assert got == {k: v for k, (_, v) in exp.items()}


def _py_fixed_holiday(d):
    return any(d.month == m and d.day == dd and d.year >= a and (b is None or d.year <= b)
               for _, m, dd, a, b in config.FIXED_DATE_HOLIDAYS)


def _py_floating_holiday(d):
    for _, m, wd, nth, a, b in config.FLOATING_HOLIDAYS:
        if d.month != m or d.weekday() != wd or d.year < a or (b is not None and d.year > b):
            continue
        if nth > 0 and (d.day - 1) // 7 + 1 == nth:
            return True
        if nth < 0 and (d + timedelta(days=7)).month != m:
            return True
    return False


def _py_business_day(d):
    holiday = (_py_fixed_holiday(d) or _py_floating_holiday(d)
               or (d.weekday() == 4 and _py_fixed_holiday(d + timedelta(days=1)))
               or (d.weekday() == 0 and _py_fixed_holiday(d - timedelta(days=1))))
    return d.weekday() < 5 and not holiday


def _py_stale(trained, now):
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo
    ny = ZoneInfo(config.MARKET_TIMEZONE)

    def close(day):
        return datetime(day.year, day.month, day.day, 16, 30, tzinfo=ny).astimezone(timezone.utc).replace(tzinfo=None)
    if trained is None:
        return True
    today = now.replace(tzinfo=timezone.utc).astimezone(ny).date()
    if _py_business_day(today):
        return trained < close(today) < now
    before = today - timedelta(days=1)
    while not _py_business_day(before):
        before -= timedelta(days=1)
    return trained < close(before)


instants = st.datetimes(min_value=__import__("datetime").datetime(1990, 1, 1),
                        max_value=__import__("datetime").datetime(2040, 12, 31))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(instants, st.integers(-200_000, 200_000)), min_size=10, max_size=40))
def test_staleness_matches_python(spark, pairs):
    from datetime import timedelta as td
    from tidecast.operators import freshness
    rows = [(now.replace(microsecond=0), (now + td(minutes=off)).replace(microsecond=0)) for now, off in pairs]
    df = spark.createDataFrame(rows, "now timestamp, trained timestamp")
    got = [r.s for r in df.select(freshness.is_stale(F.col("trained"), F.col("now")).alias("s")).collect()]
    assert got == [_py_stale(t, n) for n, t in rows]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dates(min_value=date(1960, 1, 1), max_value=date(2060, 12, 31)), min_size=20, max_size=80))
def test_business_day_rule_matches_python(spark, days):
    from tidecast.functions import calendar
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.b for r in df.select(calendar.is_business_day(F.col("d")).alias("b")).collect()]
    assert got == [_py_business_day(d) for d in days]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(6, 400), min_size=1, max_size=6), st.sampled_from([0.2, 0.25, 0.5, 0.34]))
def test_split_folds_match_definition(spark, lengths, test_size):
    from tidecast.operators import split
    k = split.n_splits_for(test_size)
    lengths = [n for n in lengths if n > k]
    if not lengths:
        return
    rows = [(f"T{i}", 5, date(2000, 1, 1) + timedelta(days=d)) for i, n in enumerate(lengths) for d in range(n)]
    df = spark.createDataFrame(rows, "ticker string, forecast_days int, date date")
    last = split.last_fold(df, test_size).collect()
    folds = split.all_folds(df, test_size).collect()
    for i, n in enumerate(lengths):
        ts = n // (k + 1)
        got_test = sorted(r.i for r in last if r.ticker == f"T{i}" and r.is_test)
        assert got_test == list(range(n - ts + 1, n + 1))
        for f, start in enumerate(range(n - k * ts, n, ts), start=1):
            tr = sorted(r.i for r in folds if r.ticker == f"T{i}" and r.fold == f and r.role == "train")
            te = sorted(r.i for r in folds if r.ticker == f"T{i}" and r.fold == f and r.role == "test")
            assert tr == list(range(1, start + 1)) and te == list(range(start + 1, start + ts + 1))
