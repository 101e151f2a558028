"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  The fixture price view (one series per supplier,
from ``lineitem``) is first stored the way the library recommends, as a
Parquet table bucketed by ticker (``prepare_prices``, timed once).  Then
``train_all`` (B1: every series x horizons 5/10/30, features -> split ->
fit -> metrics, appended to a Parquet registry) and ``forecast_all`` (B2:
latest models from that registry, serving history, recursive forecast,
written partitioned by horizon) are timed warm, median of ``$BENCH_REPS``
runs.  ``train_all_from_lineitem`` repeats the training straight from the
raw table.  Other registered queries (which derive prices from
``lineitem`` themselves) run once each through the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidecast.plans import catalog, jobs  # noqa: E402
from tidecast.session import build_session  # noqa: E402
from tidecast.sources import fixtures, read_prices, write_bucketed_prices  # noqa: E402
from tidecast.sources.prices import fixture_prices  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPS = int(os.environ.get("BENCH_REPS", "5"))
EXTRA = ("features", "train_all_models", "recursive_forecast", "business_calendar", "quality_violations",
         "history_tail", "all_folds_split")


def _sf(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    return base[2:] if base.startswith("sf") else base


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="tidecast-bench-")
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=2 * CPUS, checkpoint=f"{scratch}/ckpt")
    t = time.time()
    layout = "bucketed"
    write_bucketed_prices(fixture_prices(spark, SF_DIR), "bench_prices", 2 * CPUS, path=f"{scratch}/prices")
    prices = read_prices(spark, "bench_prices", fmt="table")
    prepare = time.time() - t
    requests = fixtures.requests(spark, SF_DIR)
    n_series = requests.select("ticker").distinct().count()

    def train_once(i: int) -> float:
        root = f"{scratch}/registry{i}"
        t = time.time()
        jobs.run_training(spark, prices, requests, root, as_of=fixtures.AS_OF,
                          now=datetime(2001, 12, 31, 22, 0, 0), horizons=fixtures.HORIZONS)
        return time.time() - t

    def forecast_once(i: int) -> float:
        t = time.time()
        st = jobs.run_forecast(spark, prices, requests, f"{scratch}/registry0", f"{scratch}/fc{i}",
                               as_of=fixtures.AS_OF, history_days=fixtures.HISTORY_DAYS)
        run_noop(st)
        return time.time() - t

    train_once(0)                      # warm-up; leaves registry0 for the forecasts
    forecast_once(0)
    train_t = [train_once(i) for i in range(1, REPS + 1)]
    fc_t = [forecast_once(i) for i in range(1, REPS + 1)]
    q = {"train_all": round(statistics.median(train_t), 3),
         "forecast_all": round(statistics.median(fc_t), 3)}
    t = time.time()
    jobs.run_training(spark, fixture_prices(spark, SF_DIR), requests, f"{scratch}/registry_raw",
                      as_of=fixtures.AS_OF, now=datetime(2001, 12, 31, 22, 0, 0), horizons=fixtures.HORIZONS)
    q["train_all_from_lineitem"] = round(time.time() - t, 3)
    # registry operators on the bench's own registry (registry0 holds the warm-up run's versions)
    t = time.time()
    run_noop(jobs.latest_models(spark, f"{scratch}/registry0", use_snapshot=False))
    q["registry_latest_from_history"] = round(time.time() - t, 3)
    jobs.compact(spark, f"{scratch}/registry0")
    t = time.time()
    run_noop(jobs.latest_models(spark, f"{scratch}/registry0"))
    q["registry_latest_snapshot"] = round(time.time() - t, 3)
    t = time.time()   # every model is fresh: the staleness check skips all training
    jobs.run_training(spark, prices, requests, f"{scratch}/registry0", as_of=fixtures.AS_OF,
                      now=datetime(2001, 12, 31, 23, 0, 0), horizons=fixtures.HORIZONS)
    q["train_all_all_fresh"] = round(time.time() - t, 3)
    q["prepare_prices"] = round(prepare, 3)
    qs = catalog.queries()
    for name in EXTRA:
        t = time.time()
        run_noop(qs[name](spark, SF_DIR))
        q[name] = round(time.time() - t, 3)
    n_models = spark.read.parquet(f"{scratch}/registry0/models").count()
    value = round(q["train_all"] + q["forecast_all"], 3)
    print(json.dumps({
        "metric": "train_all + forecast_all, warm median (sec)",
        "value": value, "unit": "sec", "queries": q, "sf": _sf(SF_DIR),
        "series": n_series, "models": n_models, "reps": REPS, "cpus": CPUS, "price_layout": layout,
        "series_per_sec_train": round(n_series / q["train_all"], 1),
        "series_per_sec_forecast": round(n_series / q["forecast_all"], 1),
    }))


if __name__ == "__main__":
    main()
