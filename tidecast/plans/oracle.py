"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code paths: windows and unions per
horizon instead of ``inline``, ``row_number``/``count`` instead of running
sums, a grouped fit joined back instead of window moments, a recursive CTE
instead of an array fold, a generated calendar joined by range instead of
array filters, and the normal equations solved by Cholesky where the
library eliminates.  The oracle shares only the fixed values (``config``,
``fixtures``) with the library.

Tables ``lineitem supplier orders customer events`` are views registered
by the caller.
"""

from __future__ import annotations

from .. import config
from ..sources import fixtures as fx

TZ = config.MARKET_TIMEZONE
W = "PARTITION BY ticker ORDER BY date"
K = 5  # n_splits for test_size 0.2
FEATS = "lag1, lag5, lag20, lag100, ma5, ma20, ma100"


def _with(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{final}" if any("rec" == n for n, _ in ctes) else f"WITH {body}\n{final}"


# --- calendar rules in SQL ----------------------------------------------------

def _years(d: str, first: int, last: int | None) -> str:
    return f"year({d}) >= {first}" + (f" AND year({d}) <= {last}" if last is not None else "")


def _fixed(d: str) -> str:
    return "(" + " OR ".join(
        f"(month({d}) = {m} AND day({d}) = {dd} AND {_years(d, a, b)})"
        for _, m, dd, a, b in config.FIXED_DATE_HOLIDAYS) + ")"


def _floating(d: str) -> str:
    terms = []
    for _, m, wd, nth, a, b in config.FLOATING_HOLIDAYS:
        which = (f"floor((day({d}) - 1) / 7) + 1 = {nth}" if nth > 0
                 else f"month({d} + 7) <> {m}")
        terms.append(f"(month({d}) = {m} AND isodow({d}) = {wd + 1} AND {which} AND {_years(d, a, b)})")
    return "(" + " OR ".join(terms) + ")"


def is_holiday(d: str) -> str:
    return (f"({_fixed(d)} OR {_floating(d)} OR (isodow({d}) = 5 AND {_fixed(f'({d} + 1)')})"
            f" OR (isodow({d}) = 1 AND {_fixed(f'({d} - 1)')}))")


def is_bd(d: str) -> str:
    return f"(isodow({d}) <= 5 AND NOT {is_holiday(d)})"


def _utc(ts: str) -> str:
    """naive UTC timestamp -> timestamptz"""
    return f"timezone('UTC', {ts})"


def _ny(ts: str) -> str:
    """naive UTC timestamp -> naive New York wall clock"""
    return f"timezone('{TZ}', {_utc(ts)})"


def _version(ticker: str, h: str, ts: str) -> str:
    return (f"concat({ticker}, '_linear_', CAST({h} AS VARCHAR), 'day_', "
            f"strftime({_ny(ts)}, '%Y%m%d%H%M%S'))")


def _api(ts: str) -> str:
    return f"strftime({_ny(ts)}, '%Y-%m-%d-%H:%M:%S')"


def _api_canon(s: str) -> str:
    """'YYYY-MM-DD-HH:MM:SS' (one-digit fields allowed) -> canonical text, NULL if malformed."""
    return (f"CASE WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}-\\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}$') "
            f"THEN strftime(try_strptime({s}, '%Y-%m-%d-%H:%M:%S'), '%Y-%m-%d-%H:%M:%S') END")


# --- base views -------------------------------------------------------------------

PRICES = ("SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(l_shipdate AS DATE) AS date,\n"
          "       max(l_extendedprice) AS close\nFROM lineitem GROUP BY 1, 2")

REQUESTS = (f"SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS ticker, CAST(v.h AS INTEGER) AS forecast_days\n"
            f"FROM supplier CROSS JOIN (VALUES {', '.join(f'({h})' for h in fx.HORIZONS)}) v(h)\n"
            f"UNION ALL SELECT '{fx.NO_DATA_TICKER}', 5")


def features_sql(src: str, carry: str = "") -> str:
    lags = ", ".join(f"lag(close, {k}) OVER ({W}) AS lag{k}" for k in config.LAGS)
    mas = ", ".join(f"avg(close) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS ma{k}"
                    for k in config.MOVING_AVERAGES)
    return (f"SELECT * FROM (SELECT ticker, date, close AS price, {carry}{lags}, {mas} FROM {src}) f\n"
            f"WHERE lag100 IS NOT NULL AND ma100 IS NOT NULL")


def _slot(i: int) -> str:
    short, medium = config.SHORT_TERM_FEATURES[i], config.MEDIUM_TERM_FEATURES[i]
    long = config.LONG_TERM_FEATURES[i] if i < 3 else "0.0"
    return (f"CASE WHEN forecast_days <= 5 THEN {short} WHEN forecast_days <= 20 THEN {medium} "
            f"ELSE {long} END AS x{i}")


def _tier_names() -> str:
    j = ",".join
    return (f"CASE WHEN forecast_days <= 5 THEN '{j(config.SHORT_TERM_FEATURES)}' "
            f"WHEN forecast_days <= 20 THEN '{j(config.MEDIUM_TERM_FEATURES)}' "
            f"ELSE '{j(config.LONG_TERM_FEATURES)}' END")


def cholesky_stages(p: int = 4, tol: float = 1e-12) -> list[list[tuple[str, str]]]:
    """Normal equations by Cholesky (C = L L^T, forward then back
    substitution) - a different route from the library's elimination.  A
    column whose remaining diagonal ``d_j`` is at most ``tol * c_jj`` is
    left out (its coefficient is 0), the same rank rule."""
    def c(i, j):
        return f"c{min(i, j)}{max(i, j)}"
    stages: list[list[tuple[str, str]]] = []
    for j in range(p):
        d = c(j, j) + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        stages.append([(f"ok{j}", f"({d}) > {tol!r} * {c(j, j)}")])
        stage = [(f"l{j}{j}", f"CASE WHEN ok{j} THEN sqrt({d}) END")]
        stages.append(stage)
        below = []
        for i in range(j + 1, p):
            num = c(i, j) + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            below.append((f"l{i}{j}", f"CASE WHEN ok{j} THEN ({num}) / l{j}{j} ELSE 0.0 END"))
        if below:
            stages.append(below)
    for j in range(p):
        num = f"b{j}" + "".join(f" - l{j}{k} * z{k}" for k in range(j))
        stages.append([(f"z{j}", f"CASE WHEN ok{j} THEN ({num}) / l{j}{j} ELSE 0.0 END")])
    for j in reversed(range(p)):
        num = f"z{j}" + "".join(f" - l{i}{j} * w{i}" for i in range(j + 1, p))
        stages.append([(f"w{j}", f"CASE WHEN ok{j} THEN ({num}) / l{j}{j} ELSE 0.0 END")])
    stages.append([("intercept", "my" + "".join(f" - w{i} * m{i}" for i in range(p)))])
    return stages


def rank_one_stages(p: int = 4) -> list[list[tuple[str, str]]]:
    """The pseudo-inverse of a covariance matrix of rank one is itself over its
    squared trace, so the least-norm solution is ``C b / tr(C)^2``."""
    def c(i, j):
        return f"c{min(i, j)}{max(i, j)}"
    trace = " + ".join(c(i, i) for i in range(p))
    return [[(f"w{i}", "(" + " + ".join(f"{c(i, j)} * b{j}" for j in range(p)) + f") / (({trace}) * ({trace}))")
             for i in range(p)],
            [("intercept", "my" + "".join(f" - w{i} * m{i}" for i in range(p)))]]


def train_ctes(tag: str, as_of: str, restrict: bool = True, guard: bool = True,
               src: str = "prices", req: str = "req", solver=cholesky_stages) -> list[tuple[str, str]]:
    """CTEs ending in ``{tag}_fit``: ticker, forecast_days, w0..w3, intercept,
    mae, r2, mape, max_ae, train_samples, test_samples, last_train_date.
    Intermediate: ``{tag}_feat``, ``{tag}_nfeat``, ``{tag}_xy``, ``{tag}_split``."""
    t = tag
    where_req = f" AND ticker IN (SELECT ticker FROM {req})" if restrict else ""
    ctes = [
        (f"{t}_win", f"SELECT * FROM {src} WHERE date <= DATE '{as_of}' "
                     f"AND date >= DATE '{as_of}' - {config.TRAIN_LOOKBACK_DAYS}{where_req}"),
        (f"{t}_feat", features_sql(f"{t}_win")),
        (f"{t}_nfeat", f"SELECT ticker, count(*) AS n_feat FROM {t}_feat GROUP BY ticker"),
        (f"{t}_tgt", "\nUNION ALL\n".join(
            f"SELECT ticker, {h} AS forecast_days, date, price, {FEATS}, "
            f"lead(price, {h}) OVER ({W}) AS target FROM {t}_feat" for h in fx.HORIZONS)),
    ]
    req_pairs = (f" AND EXISTS (SELECT 1 FROM {req} r WHERE r.ticker = g.ticker "
                 "AND r.forecast_days = g.forecast_days)") if restrict else ""
    ctes.append((f"{t}_xy", f"SELECT * FROM {t}_tgt g WHERE price IS NOT NULL AND "
                            + " AND ".join(f"{c} IS NOT NULL" for c in config.FEATURE_COLUMNS)
                            + " AND target IS NOT NULL" + req_pairs))
    ctes.append((f"{t}_slots", f"SELECT ticker, forecast_days, date, {', '.join(_slot(i) for i in range(4))}, "
                               f"target AS y FROM {t}_xy"))
    ctes.append((f"{t}_num", f"SELECT *, row_number() OVER (PARTITION BY ticker, forecast_days ORDER BY date) AS i, "
                             f"count(*) OVER (PARTITION BY ticker, forecast_days) AS n FROM {t}_slots"))
    gw = f" AND ticker IN (SELECT ticker FROM {t}_nfeat WHERE n_feat >= {config.MIN_FEATURE_ROWS})" if guard else ""
    ctes.append((f"{t}_split", f"SELECT *, i > n - floor(n / {K + 1}) AS is_test FROM {t}_num WHERE n > {K}{gw}"))
    moms = ", ".join([f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in range(4) for j in range(i, 4)]
                     + [f"covar_pop(x{i}, y) AS b{i}" for i in range(4)]
                     + [f"avg(x{i}) AS m{i}" for i in range(4)] + ["avg(y) AS my"])
    ctes.append((f"{t}_mom", f"SELECT ticker, forecast_days, count(*) AS n, {moms} FROM {t}_split "
                             f"WHERE NOT is_test GROUP BY ticker, forecast_days"))
    prev = f"{t}_mom"
    for s, stage in enumerate(solver()):
        name = f"{t}_s{s}"
        ctes.append((name, f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage)} FROM {prev}"))
        prev = name
    ctes.append((f"{t}_coef", f"SELECT ticker, forecast_days, w0, w1, w2, w3, intercept FROM {prev}"))
    ctes.append((f"{t}_scored", f"SELECT s.*, c.w0, c.w1, c.w2, c.w3, c.intercept, "
                                f"c.intercept + c.w0 * s.x0 + c.w1 * s.x1 + c.w2 * s.x2 + c.w3 * s.x3 AS yhat "
                                f"FROM {t}_split s JOIN {t}_coef c USING (ticker, forecast_days)"))
    ctes.append((f"{t}_fit", f"""SELECT ticker, forecast_days, max(w0) AS w0, max(w1) AS w1, max(w2) AS w2,
  max(w3) AS w3, max(intercept) AS intercept,
  avg(abs(y - yhat)) FILTER (WHERE is_test) AS mae,
  CASE WHEN count(*) FILTER (WHERE is_test) < 2 THEN NULL
       WHEN var_pop(y) FILTER (WHERE is_test) = 0 THEN
         CASE WHEN sum((y - yhat) * (y - yhat)) FILTER (WHERE is_test) = 0 THEN 1.0 ELSE 0.0 END
       ELSE 1 - sum((y - yhat) * (y - yhat)) FILTER (WHERE is_test)
                / (var_pop(y) FILTER (WHERE is_test) * count(*) FILTER (WHERE is_test)) END AS r2,
  avg(abs(y - yhat) / greatest(abs(y), {config.MAPE_EPSILON!r})) FILTER (WHERE is_test) AS mape,
  max(abs(y - yhat)) FILTER (WHERE is_test) AS max_ae,
  count(*) FILTER (WHERE NOT is_test) AS train_samples,
  count(*) FILTER (WHERE is_test) AS test_samples,
  max(date) AS last_train_date
FROM {t}_scored GROUP BY ticker, forecast_days"""))
    return ctes


def models_cte(tag: str, trained_at: str) -> tuple[str, str]:
    ts = f"TIMESTAMP '{trained_at}'"
    return (f"{tag}_models", f"SELECT ticker, forecast_days, 'LinearRegression' AS model_type, "
                             f"{_version('ticker', 'forecast_days', ts)} AS version, {ts} AS trained_at, "
                             f"{_tier_names()} AS features, * EXCLUDE (ticker, forecast_days) FROM {tag}_fit")


SEGMENT_PRICES = ("SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close\n"
                  "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
SEGMENT_REQUESTS = (f"SELECT DISTINCT c_mktsegment AS ticker, CAST(v.h AS INTEGER) AS forecast_days FROM customer "
                    f"CROSS JOIN (VALUES {', '.join(f'({h})' for h in fx.HORIZONS)}) v(h)")
EVENT_PRICES = ("SELECT event_type AS ticker, CAST(ts AS DATE) AS date, max(value) AS close\n"
                "FROM events GROUP BY 1, 2")


def base() -> list[tuple[str, str]]:
    return [("prices", PRICES), ("req", REQUESTS)]


def registry_ctes() -> list[tuple[str, str]]:
    return (train_ctes("r1", fx.RUN1_AS_OF) + [models_cte("r1", fx.RUN1_TRAINED_AT)]
            + train_ctes("r2", fx.RUN2_AS_OF) + [models_cte("r2", fx.RUN2_TRAINED_AT)] + [
                ("reg", "SELECT * FROM r1_models UNION ALL SELECT * FROM r2_models"),
                ("tomb", f"SELECT ticker, forecast_days, trained_at FROM r2_models "
                         f"WHERE forecast_days = {fx.DELETED_HORIZON}"),
                ("live", "SELECT * FROM reg m WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.ticker = m.ticker "
                         "AND t.forecast_days = m.forecast_days AND t.trained_at = m.trained_at)"),
                ("latest", "SELECT * FROM live QUALIFY row_number() OVER "
                           "(PARTITION BY ticker, forecast_days ORDER BY trained_at DESC) = 1"),
            ])


def clock_cte(now: str = fx.NOW, bd=is_bd) -> tuple[str, str]:
    """One row: now (timestamptz), today (NY date), today's close and the
    close of the last business day before today."""
    today = f"CAST({_ny(f'TIMESTAMP {chr(39)}{now}{chr(39)}')} AS DATE)"
    close = f"timezone('{TZ}', CAST(d AS TIMESTAMP) + INTERVAL 16 HOUR + INTERVAL 30 MINUTE)"
    return ("clock", f"""SELECT {_utc(f"TIMESTAMP '{now}'")} AS now_tz, today,
  {bd('today')} AS today_is_bd,
  (SELECT {close} FROM (SELECT today AS d)) AS close_today,
  (SELECT {close} FROM (SELECT max(d) AS d FROM (
      SELECT CAST(unnest(generate_series(today - 10, today - 1, INTERVAL 1 DAY)) AS DATE) AS d) c
   WHERE {bd('d')})) AS close_before
FROM (SELECT {today} AS today)""")


STALE = ("CASE WHEN l.trained_at IS NULL THEN true "
         "WHEN k.today_is_bd THEN timezone('UTC', l.trained_at) < k.close_today AND k.close_today < k.now_tz "
         "ELSE timezone('UTC', l.trained_at) < k.close_before END")


def serving_ctes(days: int, tag: str = "sv", src: str = "prices") -> list[tuple[str, str]]:
    return [
        (f"{tag}_src", f"SELECT ticker, date, close, max(date) OVER (PARTITION BY ticker) AS latest_date "
                       f"FROM {src} WHERE date <= DATE '{fx.AS_OF}'"),
        (f"{tag}_rng", f"SELECT * FROM {tag}_src WHERE date >= latest_date - {days}"),
        (f"{tag}_feat", features_sql(f"{tag}_rng", carry="latest_date, ")),
        (f"{tag}_tail", f"SELECT * FROM (SELECT ticker, date, price, latest_date, "
                        f"count(*) OVER (PARTITION BY ticker) AS n_hist, "
                        f"row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn_desc FROM {tag}_feat) "
                        f"WHERE rn_desc <= {config.SERVING_TAIL_ROWS}"),
        (f"{tag}_hist", f"SELECT ticker, max(latest_date) AS latest_date, max(n_hist) AS n_hist, "
                        f"list(price ORDER BY date) AS hist FROM {tag}_tail GROUP BY ticker"),
    ]


def _lag(a: str, k: int) -> str:
    return f"{a}[len({a}) - least({k}, len({a})) + 1]"


def _ma(a: str, k: int) -> str:
    return f"list_avg(list_slice({a}, len({a}) - least({k}, len({a})) + 1, len({a})))"


def _arr_feature(a: str, name: str) -> str:
    return _lag(a, int(name[3:])) if name.startswith("lag") else _ma(a, int(name[2:]))


def _pred(a: str, p: str = "") -> str:
    def tier(names):
        return f"{p}intercept" + "".join(f" + {p}w{i} * {_arr_feature(a, n)}" for i, n in enumerate(names))
    return (f"CASE WHEN {p}forecast_days <= 5 THEN {tier(config.SHORT_TERM_FEATURES)} "
            f"WHEN {p}forecast_days <= 20 THEN {tier(config.MEDIUM_TERM_FEATURES)} "
            f"ELSE {tier(config.LONG_TERM_FEATURES)} END")


def forecast_ctes(head: list[tuple[str, str]] | None = None, src: str = "prices",
                  req: str = "req", solver=cholesky_stages) -> list[tuple[str, str]]:
    """Year-end models (trained at NOW), serving history over HISTORY_DAYS,
    the recursion and its dates -> ``fc(ticker, forecast_days, step, date, predicted_price)``."""
    max_h = max(fx.HORIZONS)
    return ((base() if head is None else head) + train_ctes("ye", fx.AS_OF, src=src, req=req, solver=solver)
            + [models_cte("ye", fx.NOW)] + serving_ctes(fx.HISTORY_DAYS, src=src) + [
                ("mh", "SELECT m.ticker, m.forecast_days, m.version, m.w0, m.w1, m.w2, m.w3, m.intercept, "
                       "h.latest_date, h.n_hist, h.hist FROM ye_models m JOIN sv_hist h USING (ticker)"),
                ("rec", f"SELECT ticker, forecast_days, 0 AS step, hist AS acc, w0, w1, w2, w3, intercept "
                        f"FROM mh WHERE n_hist >= {config.MIN_FEATURE_ROWS}\nUNION ALL\n"
                        f"SELECT ticker, forecast_days, step + 1, list_append(acc, {_pred('acc')}), "
                        f"w0, w1, w2, w3, intercept FROM rec WHERE step < forecast_days"),
                ("cal", f"SELECT d, {is_bd('d')} AS bd FROM (SELECT CAST(unnest(generate_series("
                        f"(SELECT min(latest_date) FROM mh) + 1, (SELECT max(latest_date) FROM mh) + {2 * max_h + 14}, "
                        f"INTERVAL 1 DAY)) AS DATE) AS d)"),
                ("nbd", f"SELECT t.ticker, c.d AS date, row_number() OVER (PARTITION BY t.ticker ORDER BY c.d) AS step "
                        f"FROM (SELECT DISTINCT ticker, latest_date FROM mh) t JOIN cal c "
                        f"ON c.d > t.latest_date AND c.d <= t.latest_date + {2 * max_h + 14} WHERE c.bd"),
                ("fc", "SELECT r.ticker, r.forecast_days, r.step, n.date, r.acc[len(r.acc)] AS predicted_price "
                       "FROM rec r JOIN nbd n ON n.ticker = r.ticker AND n.step = r.step WHERE r.step > 0"),
            ])


def _ma_proj(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{m}, 6) AS {m}" for m in ("ma5", "ma20", "ma100"))


def _metrics_proj(p: str = "") -> str:
    return (f"round({p}mae, 2) AS mae, round({p}r2, 6) AS r2, round({p}mape, 6) AS mape, "
            f"round({p}max_ae, 2) AS max_ae, CAST({p}train_samples AS BIGINT) AS train_samples, "
            f"CAST({p}test_samples AS BIGINT) AS test_samples")


def _lookup_result(lookups: str) -> str:
    return f"""SELECT q.ticker, CAST(q.forecast_days AS BIGINT) AS forecast_days, q.last_trained_time,
  CASE WHEN m.ticker IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN m.ticker IS NULL THEN '{config.MODEL_NOT_FOUND}' END AS error_code,
  m.version, round(m.mae, 2) AS mae
FROM ({lookups}) q LEFT JOIN live m ON m.ticker = q.ticker AND m.forecast_days = q.forecast_days
  AND {_api('m.trained_at')} = {_api_canon('q.last_trained_time')}"""


def _quality_src() -> str:
    return """SELECT o_orderkey AS request_id, o_orderpriority AS ticker,
  CAST(floor(o_totalprice) AS BIGINT) % 400 AS forecast_days,
  CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') ELSE o_orderpriority END AS start_date,
  strftime(CAST(o_orderdate AS DATE) + CAST(((o_orderkey % 3) - 1) * 30 AS INTEGER), '%Y-%m-%d') AS end_date,
  CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d-%H:%M:%S')
       ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS trained_time,
  o_totalprice AS close
FROM orders"""


BAD_TICKER = "(ticker IS NULL OR regexp_matches(ticker, '^\\s*$') OR length(ticker) > 10)"
BAD_H = "(forecast_days IS NULL OR forecast_days < 1 OR forecast_days > 365)"


def _date_text(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN try_strptime({s}, '%Y-%m-%d') END"


def _bad_date(s: str) -> str:
    return f"({_date_text(s)} IS NULL)"


def oracle_sql() -> dict[str, str]:
    fit_cols = "w0, w1, w2, w3"
    q: dict[str, str] = {}
    b = base()

    q["features"] = _with(b, f"SELECT ticker, date, price, lag1, lag5, lag20, lag100, {_ma_proj()} "
                             f"FROM ({features_sql('prices')})")
    q["features_in_range"] = _with(b + [("rng", "SELECT * FROM prices WHERE date >= DATE '1997-01-01' AND "
                                                "date <= DATE '2000-12-31' AND ticker IN (SELECT ticker FROM req)")],
                                   f"SELECT ticker, date, price, lag1, lag5, lag20, lag100, {_ma_proj()} "
                                   f"FROM ({features_sql('rng')})")
    one = b + [("one", f"SELECT '{fx.ONE_TICKER}' AS ticker, date, max(close) AS close FROM prices GROUP BY date"),
               ("one_feat", features_sql("one"))]
    q["features_one_series"] = _with(one, f"SELECT ticker, date, price, lag1, lag5, lag20, lag100, {_ma_proj()} FROM one_feat")
    q["targets_one_series"] = _with(one, "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT ticker, CAST({h} AS BIGINT) AS forecast_days, date, price, lead(price, {h}) OVER ({W}) AS target FROM one_feat"
        for h in (*fx.HORIZONS, 100)) + ") WHERE target IS NOT NULL")
    q["latest_date"] = _with(b, f"SELECT t.ticker, l.latest_date, CASE WHEN l.latest_date IS NULL THEN "
                                f"'{config.INSUFFICIENT_DATA}' END AS error_code FROM (SELECT DISTINCT ticker FROM req) t "
                                f"LEFT JOIN (SELECT ticker, max(date) AS latest_date FROM prices GROUP BY ticker) l "
                                f"USING (ticker)")
    suff = (b + train_ctes("tw", fx.AS_OF, restrict=False, guard=False) + serving_ctes(180, "s180")
            + serving_ctes(900, "s900") + [
                ("cnt", "SELECT ticker, 'train_1095' AS frame, count(*) AS n FROM tw_feat GROUP BY ticker "
                        "UNION ALL SELECT ticker, 'serve_180', count(*) FROM s180_feat GROUP BY ticker "
                        "UNION ALL SELECT ticker, 'serve_900', count(*) FROM s900_feat GROUP BY ticker")])
    q["sufficiency_guard"] = _with(suff, f"""SELECT t.ticker, w.frame, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows,
  CASE WHEN coalesce(c.n, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}' END AS error_code
FROM (SELECT DISTINCT ticker FROM req) t
CROSS JOIN (VALUES ('train_1095'), ('serve_180'), ('serve_900')) w(frame)
LEFT JOIN cnt c ON c.ticker = t.ticker AND c.frame = w.frame""")
    q["training_window"] = _with(b, f"SELECT ticker, date, close FROM prices WHERE date <= DATE '{fx.AS_OF}' "
                                    f"AND date >= DATE '{fx.AS_OF}' - {config.TRAIN_LOOKBACK_DAYS}")

    q["training_window_years"] = _with(b, f"SELECT ticker, date, close FROM prices WHERE date <= DATE '{fx.RUN1_AS_OF}' "
                                          f"AND date >= DATE '{fx.RUN1_AS_OF}' - {config.TRAIN_LOOKBACK_DAYS}")

    tw = b + train_ctes("tw", fx.AS_OF, restrict=False, guard=False)
    q["targets_multi_horizon"] = _with(tw, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, date, "
                                           "price, target FROM tw_xy")
    q["feature_slots"] = _with(tw, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, date, "
                                   + ", ".join(f"round(x{i}, 6) AS x{i}" for i in range(4)) + ", y FROM tw_slots")
    q["last_fold_split"] = _with(tw, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, date, "
                                     "CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, is_test FROM tw_split")
    q["all_folds_split"] = _with(tw, f"""SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days,
  CAST(f.fold AS BIGINT) AS fold, date, CAST(i AS BIGINT) AS i,
  CASE WHEN i <= n - ({K} - f.fold + 1) * floor(n / {K + 1}) THEN 'train' ELSE 'test' END AS role
FROM tw_num CROSS JOIN (VALUES {', '.join(f'({f})' for f in range(1, K + 1))}) f(fold)
WHERE n > {K} AND i <= n - ({K} - f.fold + 1) * floor(n / {K + 1}) + floor(n / {K + 1})""")
    q["fold_intervals"] = _with(tw, f"""SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, date, CAST(i AS BIGINT) AS i,
  CAST(max(CASE WHEN i > start AND i <= start + ts THEN fold END) AS BIGINT) AS test_fold,
  CAST(min(CASE WHEN i <= start THEN fold END) AS BIGINT) AS first_train_fold
FROM (SELECT *, n - ({K} - f.fold + 1) * floor(n / {K + 1}) AS start, floor(n / {K + 1}) AS ts
      FROM tw_num CROSS JOIN (VALUES {', '.join(f'({f})' for f in range(1, K + 1))}) f(fold) WHERE n > {K})
GROUP BY ticker, forecast_days, date, i""")
    centred = [f"c{i}{j}" for i in range(4) for j in range(i, 4)] + [f"b{i}" for i in range(4)]
    sums = ", ".join(f"CAST(sum(CAST(round({c}, 4) AS DECIMAL(18, 4))) AS DOUBLE) AS s{c[1:] if c != 'y' else 'y'}"
                     for c in ("x0", "x1", "x2", "x3", "y"))
    q["ols_moments"] = _with(tw + [("sums", f"SELECT ticker, forecast_days, {sums} FROM tw_split "
                                            f"WHERE NOT is_test GROUP BY ticker, forecast_days")],
                             "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                             "CAST(n AS BIGINT) AS n, "
                             + ", ".join(f"printf('%.8e', {c}) AS {c}" for c in centred)
                             + ", s0, s1, s2, s3, sy FROM tw_mom JOIN sums USING (ticker, forecast_days)")
    coef_rows = []
    for i in range(4):
        names = [config.SHORT_TERM_FEATURES[i], config.MEDIUM_TERM_FEATURES[i]] + \
                ([config.LONG_TERM_FEATURES[i]] if i < 3 else [])
        feat = (f"CASE WHEN forecast_days <= 5 THEN '{names[0]}' WHEN forecast_days <= 20 THEN '{names[1]}' "
                + (f"ELSE '{names[2]}' END" if i < 3 else "END"))
        cond = "" if i < 3 else " WHERE forecast_days <= 20"
        coef_rows.append(f"SELECT ticker, forecast_days, {feat} AS feature, round(w{i}, 6) AS coefficient "
                         f"FROM tw_coef{cond}")
    coef_rows.append("SELECT ticker, forecast_days, 'intercept', round(intercept, 2) FROM tw_coef")
    q["ols_coefficients"] = _with(tw, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, feature, "
                                      "coefficient FROM (" + "\nUNION ALL\n".join(coef_rows) + ")")
    q["ols_incremental"] = q["ols_coefficients"]
    q["model_metrics"] = _with(tw, f"SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                   f"{_metrics_proj()} FROM tw_fit")
    q["last_train_date"] = _with(tw, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                     "max(date) AS last_train_date FROM tw_split GROUP BY ticker, forecast_days")

    ye = b + train_ctes("ye", fx.AS_OF) + [models_cte("ye", fx.NOW)]

    def model_proj(p: str = "") -> str:
        return (f"{p}ticker, CAST({p}forecast_days AS BIGINT) AS forecast_days, {p}model_type, {p}version, "
                f"strftime({p}trained_at, '%Y-%m-%d %H:%M:%S') AS trained_at, {p}features, "
                + ", ".join(f"round({p}{w}, 6) AS {w}" for w in fit_cols.split(", "))
                + f", round({p}intercept, 2) AS intercept, {_metrics_proj(p)}, {p}last_train_date")
    q["train_all_models"] = _with(ye, f"SELECT {model_proj()} FROM ye_models")
    q["model_card"] = _with(ye, """SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, version,
  printf('$%.2f', mae) AS mae_label, printf('%.4f', r2) AS r2_label, printf('%.2f%%', mape * 100) AS mape_label,
  printf('$%.2f', max_ae) AS max_ae_label, CAST(train_samples AS BIGINT) AS train_samples,
  CAST(test_samples AS BIGINT) AS test_samples FROM ye_models""")

    reg = b + registry_ctes()
    q["registry_list"] = _with(reg, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, version, "
                                    "strftime(trained_at, '%Y-%m-%d %H:%M:%S') AS trained_at, round(mae, 2) AS mae, "
                                    "round(r2, 6) AS r2, CAST(train_samples AS BIGINT) AS train_samples, "
                                    "CAST(test_samples AS BIGINT) AS test_samples, last_train_date FROM live")
    q["registry_count"] = _with(reg, "SELECT CAST(count(*) AS BIGINT) AS count FROM live")
    q["registry_latest"] = _with(reg, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, version, "
                                      "strftime(trained_at, '%Y-%m-%d %H:%M:%S') AS trained_at FROM latest")
    lookups = (f"SELECT ticker, forecast_days, {_api('trained_at')} AS last_trained_time FROM reg "
               f"UNION ALL SELECT ticker, forecast_days, {_api('trained_at + INTERVAL 1 SECOND')} FROM reg "
               f"WHERE forecast_days = 5")
    q["registry_get"] = _with(reg, _lookup_result(lookups))
    some = (f"SELECT ticker, forecast_days, {_api('trained_at')} AS last_trained_time FROM reg "
            f"WHERE forecast_days <> 5 AND CAST(substr(ticker, 2) AS INTEGER) % 5 = 2")
    q["registry_look_up"] = _with(reg, f"SELECT * EXCLUDE (mae) FROM ({_lookup_result(some)})")
    dels = (f"SELECT ticker, forecast_days, {_api('trained_at')} AS last_trained_time FROM r2_models "
            f"WHERE forecast_days IN (5, {fx.DELETED_HORIZON})")
    q["registry_delete"] = _with(reg, f"""SELECT q.ticker, CAST(q.forecast_days AS BIGINT) AS forecast_days,
  q.last_trained_time, CASE WHEN m.ticker IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN m.ticker IS NULL THEN '{config.MODEL_NOT_FOUND}' END AS error_code,
  CASE WHEN m.ticker IS NOT NULL THEN {_version('q.ticker', 'q.forecast_days', 'm.trained_at')} END AS version
FROM ({dels}) q LEFT JOIN live m ON m.ticker = q.ticker AND m.forecast_days = q.forecast_days
  AND {_api('m.trained_at')} = {_api_canon('q.last_trained_time')}""")
    pat = r"^(.+)_linear_(\d+)day_(\d{14})$"
    local = f"strptime(regexp_extract(version, '{pat}', 3), '%Y%m%d%H%M%S')"
    q["version_strings"] = _with(reg, f"""SELECT version, regexp_extract(version, '{pat}', 1) AS parsed_ticker,
  CAST(regexp_extract(version, '{pat}', 2) AS BIGINT) AS parsed_forecast_days,
  strftime(timezone('UTC', timezone('{TZ}', {local})), '%Y-%m-%d %H:%M:%S') AS parsed_trained_at,
  {_api('trained_at')} AS api_datetime,
  strftime(strptime({_api('trained_at')}, '%Y-%m-%d-%H:%M:%S'), '%Y%m%d%H%M%S') AS version_time,
  concat(ticker, '_linear_', CAST(forecast_days AS VARCHAR), 'day_%') AS prefix,
  version LIKE concat(ticker, '_linear_', CAST(forecast_days AS VARCHAR), 'day_%') AS prefix_match
FROM reg""")

    fresh = reg + [clock_cte()]
    q["needs_training"] = _with(fresh, f"""SELECT r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days,
  l.version, {STALE} AS needs_training
FROM req r LEFT JOIN latest l ON l.ticker = r.ticker AND l.forecast_days = r.forecast_days CROSS JOIN clock k""")
    q["skip_report"] = _with(fresh, f"""SELECT l.ticker, CAST(l.forecast_days AS BIGINT) AS forecast_days, l.version,
  'skipped' AS status, {_metrics_proj('l.')}, l.last_train_date
FROM req r JOIN latest l ON l.ticker = r.ticker AND l.forecast_days = r.forecast_days CROSS JOIN clock k
WHERE NOT ({STALE})""")

    q["business_calendar"] = _with(b, f"""SELECT d AS date, CAST(isodow(d) - 1 AS BIGINT) AS weekday,
  {is_holiday('d')} AS is_holiday, {is_bd('d')} AS is_business_day,
  CAST(sum(CASE WHEN {is_bd('d')} THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bd_index
FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM prices), (SELECT max(date) FROM prices),
      INTERVAL 1 DAY)) AS DATE) AS d)""")
    q["next_business_days"] = _with(b + [
        ("lt", "SELECT ticker, max(date) AS latest_date FROM prices GROUP BY ticker"),
        ("cal", f"SELECT d FROM (SELECT CAST(unnest(generate_series((SELECT min(latest_date) FROM lt) + 1, "
                f"(SELECT max(latest_date) FROM lt) + 74, INTERVAL 1 DAY)) AS DATE) AS d) WHERE {is_bd('d')}")],
        """SELECT ticker, CAST(step AS BIGINT) AS step, date FROM (
  SELECT lt.ticker, cal.d AS date, row_number() OVER (PARTITION BY lt.ticker ORDER BY cal.d) AS step
  FROM lt JOIN cal ON cal.d > lt.latest_date AND cal.d <= lt.latest_date + 74) WHERE step <= 30""")
    q["last_business_day"] = _with(b + [
        ("dd", "SELECT DISTINCT date FROM prices"),
        ("cal", f"SELECT d FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM dd) - 10, "
                f"(SELECT max(date) FROM dd), INTERVAL 1 DAY)) AS DATE) AS d) WHERE {is_bd('d')}")],
        "SELECT dd.date, max(cal.d) AS last_business_day FROM dd JOIN cal ON cal.d < dd.date "
        "AND cal.d >= dd.date - 10 GROUP BY dd.date")

    sv = b + serving_ctes(fx.HISTORY_DAYS)
    q["history_tail"] = _with(sv, "SELECT ticker, date, price, CAST(rn_desc AS BIGINT) AS rn_desc, latest_date, "
                                  "CAST(n_hist AS BIGINT) AS n_hist FROM sv_tail")
    q["serving_features"] = _with(sv, "SELECT ticker, CAST(n_hist AS BIGINT) AS n_hist, "
                                      + ", ".join(f"{_lag('hist', k)} AS lag{k}" for k in config.LAGS) + ", "
                                      + ", ".join(f"round({_ma('hist', k)}, 6) AS ma{k}"
                                                  for k in config.MOVING_AVERAGES)
                                      + " FROM sv_hist")
    fc = forecast_ctes()
    q["single_prediction"] = _with(fc, f"""SELECT m.ticker, CAST(m.forecast_days AS BIGINT) AS forecast_days, m.version,
  n.date, round({_pred('m.hist', 'm.')}, 2) AS predicted_price, {_tier_names()} AS features_used
FROM mh m JOIN nbd n ON n.ticker = m.ticker AND n.step = 1""")
    q["recursive_forecast"] = _with(fc, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                        "CAST(step AS BIGINT) AS step, date, round(predicted_price, 2) AS predicted_price "
                                        "FROM fc")
    q["history_plus_forecast"] = _with(fc, """SELECT ticker, CAST(NULL AS BIGINT) AS forecast_days, CAST(NULL AS BIGINT) AS step,
  date, round(price, 2) AS price, 'history' AS kind FROM sv_tail
UNION ALL
SELECT ticker, CAST(forecast_days AS BIGINT), CAST(step AS BIGINT), date, round(predicted_price, 2), 'forecast' FROM fc""")
    q["forecast_all"] = _with(fc, f"""SELECT r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days,
  CASE WHEN m.version IS NULL OR coalesce(h.n_hist, 0) < {config.MIN_FEATURE_ROWS} THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN m.version IS NULL THEN '{config.MODEL_NOT_FOUND}'
       WHEN coalesce(h.n_hist, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}' END AS error_code,
  CAST(coalesce(s.steps, 0) AS BIGINT) AS steps, s.last_date
FROM (SELECT DISTINCT ticker, forecast_days FROM req) r
LEFT JOIN ye_models m ON m.ticker = r.ticker AND m.forecast_days = r.forecast_days
LEFT JOIN sv_hist h ON h.ticker = r.ticker
LEFT JOIN (SELECT ticker, forecast_days, count(*) AS steps, max(date) AS last_date FROM fc
           GROUP BY ticker, forecast_days) s ON s.ticker = r.ticker AND s.forecast_days = r.forecast_days""")
    q["forecast_report"] = _with(fc, """SELECT f.ticker, CAST(f.forecast_days AS BIGINT) AS forecast_days,
  CAST(f.step AS BIGINT) AS step, strftime(f.date, '%a, %b %-d, %Y') AS date_label,
  printf('$%.2f', f.predicted_price) AS price_label, printf('%.4f', m.r2) AS r2_label,
  printf('%.2f%%', m.mape * 100) AS mape_label
FROM fc f JOIN ye_models m ON m.ticker = f.ticker AND m.forecast_days = f.forecast_days""")

    bad_dt = ("(CASE WHEN regexp_matches(trained_time, '^\\d{4}-\\d{1,2}-\\d{1,2}-\\d{1,2}:\\d{1,2}:\\d{1,2}$') "
              "THEN try_strptime(trained_time, '%Y-%m-%d-%H:%M:%S') END IS NULL)")
    rng = f"coalesce({_date_text('start_date')} > {_date_text('end_date')}, false)"
    v = (f"concat_ws(',', CASE WHEN {BAD_TICKER} THEN 'ticker' END, CASE WHEN {BAD_H} THEN 'forecast_days' END, "
         f"CASE WHEN {_bad_date('start_date')} THEN 'start_date' END, "
         f"CASE WHEN {_bad_date('end_date')} THEN 'end_date' END, CASE WHEN {rng} THEN 'date_range' END, "
         f"CASE WHEN {bad_dt} THEN 'trained_time' END, "
         f"CASE WHEN isnan(close) OR isinf(close) THEN 'close' END)")
    q["quality_violations"] = f"SELECT request_id, {v} AS violations, {v} = '' AS valid FROM ({_quality_src()})"

    number = "CAST(substr(ticker, 2) AS INTEGER)"
    guarded = b + [("gp", f"""SELECT ticker, date, CASE WHEN {number} % 5 = 0 AND date >= DATE '2001-06-01' AND day(date) = 13
    THEN CAST('NaN' AS DOUBLE) ELSE close END AS close FROM prices
  UNION ALL SELECT * FROM prices WHERE {number} % 7 = 3 AND date >= DATE '2001-06-01' AND day(date) = 21""")]
    bad = " OR ".join(f"isnan({c}) OR isinf({c})" for c in ("x0", "x1", "x2", "x3", "y"))
    q["row_guards"] = _with(guarded + train_ctes("r2", fx.AS_OF, src="gp")[:6] + [
        ("xyn", f"SELECT ticker, forecast_days, count(*) AS n, count(*) FILTER (WHERE {bad}) AS n_bad FROM r2_slots "
                "GROUP BY ticker, forecast_days"),
        ("dups", "SELECT ticker, count(*) - count(DISTINCT date) AS n_dup FROM r2_win GROUP BY ticker")], f"""SELECT r.ticker,
  CAST(r.forecast_days AS BIGINT) AS forecast_days, CAST(coalesce(f.n_feat, 0) AS BIGINT) AS n_feature_rows,
  CAST(coalesce(x.n, 0) AS BIGINT) AS n_xy, CAST(coalesce(x.n_bad, 0) AS BIGINT) AS n_bad,
  CAST(CASE WHEN f.n_feat IS NULL THEN 0 ELSE coalesce(d.n_dup, 0) END AS BIGINT) AS n_dup,
  CASE WHEN f.n_feat IS NOT NULL AND d.n_dup > 0 THEN '{config.DUPLICATE_DAYS}'
       WHEN coalesce(f.n_feat, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}'
       WHEN coalesce(x.n, 0) <= {K} OR x.n_bad > 0 THEN '{config.TRAINING_FAILED}' END AS error_code,
  'lag5,ma20' AS missing_columns
FROM req r LEFT JOIN r2_nfeat f ON f.ticker = r.ticker
LEFT JOIN dups d ON d.ticker = r.ticker
LEFT JOIN xyn x ON x.ticker = r.ticker AND x.forecast_days = r.forecast_days""")

    rl = reg + [clock_cte(), ("rreq", "SELECT * FROM req UNION ALL SELECT DISTINCT o_orderpriority, 5 FROM orders"),
                ("xyn", "SELECT ticker, forecast_days, count(*) AS n FROM r2_xy GROUP BY ticker, forecast_days")]
    q["run_log"] = _with(rl, f"""SELECT r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days,
  CASE WHEN {BAD_TICKER.replace('ticker', 'r.ticker')} THEN 'failed'
       WHEN NOT ({STALE}) THEN 'skipped'
       WHEN f.ticker IS NOT NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN {BAD_TICKER.replace('ticker', 'r.ticker')} THEN '{config.INVALID_REQUEST}'
       WHEN NOT ({STALE}) THEN NULL
       WHEN f.ticker IS NOT NULL THEN NULL
       WHEN coalesce(nf.n_feat, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}'
       ELSE '{config.TRAINING_FAILED}' END AS error_code,
  CASE WHEN {BAD_TICKER.replace('ticker', 'r.ticker')} THEN NULL
       WHEN NOT ({STALE}) THEN l.version
       WHEN f.ticker IS NOT NULL THEN {_version('r.ticker', 'r.forecast_days', f"TIMESTAMP '{fx.NOW}'")} END AS version
FROM rreq r
LEFT JOIN latest l ON l.ticker = r.ticker AND l.forecast_days = r.forecast_days
LEFT JOIN r2_fit f ON f.ticker = r.ticker AND f.forecast_days = r.forecast_days
LEFT JOIN r2_nfeat nf ON nf.ticker = r.ticker
CROSS JOIN clock k""")
    raw = [("raw", """SELECT concat('S', CAST(l_suppkey AS VARCHAR), CASE WHEN l_suppkey % 4 = 0 THEN '-LONG-NAME' ELSE '' END) AS ticker,
  CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS DATE) END AS date,
  CASE WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE)
       ELSE l_extendedprice END AS close FROM lineitem""")]
    q["price_quality"] = _with(raw, f"""SELECT ticker, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) - count(DISTINCT date) AS BIGINT) AS n_duplicate_days,
  CAST(count(*) FILTER (WHERE isnan(close) OR isinf(close)) AS BIGINT) AS n_bad_close,
  CAST(count(*) FILTER (WHERE date IS NULL) AS BIGINT) AS n_null_date,
  bool_or({BAD_TICKER}) AS bad_ticker
FROM raw GROUP BY ticker""")
    seg = [("seg_prices", SEGMENT_PRICES), ("seg_req", SEGMENT_REQUESTS)]
    segm = seg + train_ctes("ye", fx.AS_OF, src="seg_prices", req="seg_req") + [models_cte("ye", fx.NOW)]
    q["segment_models"] = _with(segm, f"SELECT {model_proj()} FROM ye_models")
    q["segment_forecast"] = _with(forecast_ctes(seg, src="seg_prices", req="seg_req"),
                                  "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                  "CAST(step AS BIGINT) AS step, date, round(predicted_price, 2) AS predicted_price "
                                  "FROM fc")
    ev = [("ev_prices", EVENT_PRICES),
          ("ev_req", "SELECT DISTINCT event_type AS ticker, 5 AS forecast_days FROM events")]
    evt = ev + train_ctes("ev", fx.EVENTS_AS_OF, src="ev_prices", req="ev_req")
    q["event_run_log"] = _with(evt, f"""SELECT r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days,
  CASE WHEN f.ticker IS NULL THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN f.ticker IS NULL THEN
    CASE WHEN coalesce(nf.n_feat, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}'
         ELSE '{config.TRAINING_FAILED}' END END AS error_code,
  CAST(coalesce(nf.n_feat, 0) AS BIGINT) AS n_feature_rows,
  CAST((SELECT count(*) FROM ev_prices p WHERE p.ticker = r.ticker) AS BIGINT) AS n_days
FROM ev_req r LEFT JOIN ev_fit f ON f.ticker = r.ticker AND f.forecast_days = r.forecast_days
LEFT JOIN ev_nfeat nf ON nf.ticker = r.ticker""")
    stale_at = "\nUNION ALL\n".join(
        f"SELECT '{now}' AS now, r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days, {STALE} AS needs_training "
        f"FROM req r LEFT JOIN latest l ON l.ticker = r.ticker AND l.forecast_days = r.forecast_days CROSS JOIN clock{i} k"
        for i, now in enumerate(fx.INSTANTS))
    q["needs_training_instants"] = _with(reg + [(f"clock{i}", clock_cte(now)[1]) for i, now in enumerate(fx.INSTANTS)], stale_at)
    def other_bd(d: str) -> str:
        return f"(isodow({d}) NOT IN (5, 6) AND NOT (month({d}) = 12 AND day({d}) = 31))"
    xx = fx.OTHER_COUNTRY
    land = f"CASE WHEN coalesce(TRY_CAST(substr({{t}}.ticker, 2) AS INTEGER), 0) % 2 = 1 THEN 'US' ELSE '{xx}' END"
    both = [(f"{c}{i}", clock_cte(now, bd)[1]) for i, now in enumerate(fx.INSTANTS) for c, bd in (("us", is_bd), ("ot", other_bd))]
    by_land = "\nUNION ALL\n".join(
        f"SELECT '{now}' AS now, {land.format(t='r')} AS country, r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days, {STALE} AS needs_training "
        f"FROM req r LEFT JOIN latest l ON l.ticker = r.ticker AND l.forecast_days = r.forecast_days "
        f"JOIN (SELECT 'US' AS land, * FROM us{i} UNION ALL SELECT '{xx}', * FROM ot{i}) k ON k.land = {land.format(t='r')}"
        for i, now in enumerate(fx.INSTANTS))
    q["needs_training_calendars"] = _with(reg + both, by_land)
    q["next_sessions"] = _with(b + [
        ("latest_dates", f"SELECT ticker, {land.format(t='prices')} AS country, max(date) AS latest_date FROM prices GROUP BY 1, 2"),
        ("cal", f"SELECT d, {is_bd('d')} AS us, {other_bd('d')} AS ot FROM (SELECT CAST(unnest(generate_series("
                f"(SELECT min(date) FROM prices), DATE '{fx.CALENDAR_END}', INTERVAL 1 DAY)) AS DATE) AS d)"),
        ("open_days", f"SELECT 'US' AS country, d FROM cal WHERE us UNION ALL SELECT '{xx}', d FROM cal WHERE ot")],
        """SELECT l.ticker, l.country, l.latest_date,
  (SELECT max(d) FROM open_days p WHERE p.country = l.country AND p.d < l.latest_date) AS last_business_day,
  row_number() OVER (PARTITION BY l.ticker ORDER BY o.d) AS step, o.d AS date
FROM latest_dates l JOIN open_days o ON o.country = l.country AND o.d > l.latest_date
QUALIFY step <= 30""")
    corrupt = (f"(l.trained_at = TIMESTAMP '{fx.RUN2_TRAINED_AT}' AND l.forecast_days = 30 "
               "AND CAST(substr(l.ticker, 2) AS INTEGER) % 3 = 0)")
    q["registry_corrupt"] = _with(reg + serving_ctes(fx.HISTORY_DAYS), f"""SELECT ticker, forecast_days, version,
  CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS status, error_code
FROM (SELECT r.ticker, CAST(r.forecast_days AS BIGINT) AS forecast_days, l.version,
  CASE WHEN l.version IS NULL THEN '{config.MODEL_NOT_FOUND}' WHEN {corrupt} THEN '{config.MODEL_CORRUPTED}'
       WHEN coalesce(h.n_hist, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}' END AS error_code
  FROM (SELECT DISTINCT ticker, forecast_days FROM req) r
  LEFT JOIN latest l ON l.ticker = r.ticker AND l.forecast_days = r.forecast_days
  LEFT JOIN sv_hist h ON h.ticker = r.ticker)""")
    q["registry_files"] = q["registry_latest"]
    line = [("seg_prices", SEGMENT_PRICES), ("seg_req", SEGMENT_REQUESTS),
            ("line", "SELECT ticker, date, CAST(150 + row_number() OVER (PARTITION BY ticker ORDER BY date) AS DOUBLE) AS close FROM seg_prices")]
    lined = line + train_ctes("ye", fx.AS_OF, src="line", req="seg_req", solver=rank_one_stages)
    q["ols_collinear"] = _with(lined, "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                      + ", ".join(f"round(w{i}, 6) AS w{i}" for i in range(4))
                                      + ", round(intercept, 2) AS intercept FROM ye_fit")
    q["forecast_collinear"] = _with(forecast_ctes(line, src="line", req="seg_req", solver=rank_one_stages),
                                    "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                    "CAST(step AS BIGINT) AS step, date, round(predicted_price, 2) AS predicted_price FROM fc")
    q["predict_named"] = _with(reg + serving_ctes(fx.HISTORY_DAYS), f"""SELECT m.ticker,
  CAST(m.forecast_days AS BIGINT) AS forecast_days, m.version,
  DATE '{fx.AS_OF}' + CAST(length(m.ticker) AS INTEGER) AS date,
  round({_pred('h.hist', 'm.')}, 2) AS predicted_price, {_tier_names()} AS features_used
FROM r1_models m JOIN sv_hist h ON h.ticker = m.ticker WHERE m.forecast_days = 30""")
    part = "CAST(substr(m.ticker, 2) AS INTEGER)"
    code = f"CASE WHEN {part} % 4 = 1 THEN '{config.MODEL_NOT_FOUND}' WHEN {part} % 3 = 0 THEN '{config.MODEL_CORRUPTED}' " \
           f"WHEN coalesce(h.n_hist, 0) < {config.MIN_FEATURE_ROWS} THEN '{config.INSUFFICIENT_DATA}' END"
    q["predict_named_status"] = _with(reg + serving_ctes(fx.HISTORY_DAYS), f"""SELECT ticker, version, date,
  CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS status, error_code,
  CASE WHEN error_code IS NULL THEN round(p, 2) END AS predicted_price
FROM (SELECT m.ticker, CASE WHEN {part} % 4 = 1 THEN concat(m.version, '0') ELSE m.version END AS version,
        DATE '{fx.AS_OF}' AS date, {code} AS error_code, {_pred('h.hist', 'm.')} AS p
      FROM r1_models m LEFT JOIN sv_hist h ON h.ticker = m.ticker WHERE m.forecast_days = 5)""")
    q["forecast_files"] = _with(forecast_ctes(), "SELECT ticker, CAST(forecast_days AS BIGINT) AS forecast_days, "
                                                 "CAST(step AS BIGINT) AS step, date, round(predicted_price, 2) AS predicted_price "
                                                 "FROM fc WHERE forecast_days = 10")
    q["daily_close"] = """SELECT event_type AS ticker, CAST(ts AS DATE) AS date, value AS close FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"""
    return q
