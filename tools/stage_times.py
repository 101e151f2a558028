"""Stage timings of the headline jobs from Spark's event log (no UI).

usage: python tools/stage_times.py [sf_dir]
Writes the event log to a fresh scratch folder, runs the training and
forecast jobs once cold and once warm, and prints the slowest stages of the
warm run with their task counts and shuffle volumes.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="tidecast-events-")
    os.makedirs(f"{scratch}/events")
    spark = (SparkSession.builder.master("local[8]").appName("tidecast-stages")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"{scratch}/events")
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.checkpoint.dir", f"{scratch}/ckpt").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", os.environ.get("MIN_PART", "1MB"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tidecast.plans import jobs
    from tidecast.sources import fixtures
    from tidecast.sources.prices import fixture_prices
    prices, req = fixture_prices(spark, sf), fixtures.requests(spark, sf)
    for run in ("cold", "warm"):
        spark.sparkContext.setJobGroup(run, run)
        jobs.run_training(spark, prices, req, f"{scratch}/reg_{run}", as_of=fixtures.AS_OF,
                          now=datetime(2001, 12, 31, 22), horizons=fixtures.HORIZONS)
        st = jobs.run_forecast(spark, prices, req, f"{scratch}/reg_{run}", f"{scratch}/fc_{run}",
                               as_of=fixtures.AS_OF, history_days=fixtures.HISTORY_DAYS)
        st.write.format("noop").mode("overwrite").save()
    spark.stop()
    stages, job_group = {}, {}
    for path in glob.glob(f"{scratch}/events/**", recursive=True):
        if os.path.isdir(path):
            continue
        for line in open(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e["Stage IDs"]:
                    job_group[sid] = group
            elif e["Event"] == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                if "Completion Time" not in info or "Submission Time" not in info:
                    continue
                acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
                stages[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"], info["Number of Tasks"],
                                            info["Stage Name"][:60], acc.get("internal.metrics.shuffle.write.bytesWritten"),
                                            acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or
                                            acc.get("internal.metrics.shuffle.read.localBytesRead"))
    warm = {k: v for k, v in stages.items() if job_group.get(k) == "warm"}
    total = sum(v[0] for v in warm.values())
    print(f"warm stages: {len(warm)}, summed stage time {total / 1000:.2f} s")
    for sid, (ms, ntask, name, wbytes, rbytes) in sorted(warm.items(), key=lambda kv: -kv[1][0])[:15]:
        print(f"  stage {sid:4d} {ms:6d} ms tasks {ntask:4d} shuffle_w {wbytes} shuffle_r {rbytes}  {name}")


if __name__ == "__main__":
    main()
