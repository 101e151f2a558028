"""Print the physical plans of the headline jobs as they would run at scale.

usage: python tools/explain.py [sf_dir] [--full]

Prices are first written to a scratch Parquet table (so the scan shows
pushdown as it would on a real price table) and static broadcast is turned
off (at 100 TB nothing on the price path is under the threshold); AQE may
still broadcast small key tables at run time by their measured size.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidecast.plans import forecast as fplan  # noqa: E402
from tidecast.plans import train  # noqa: E402
from tidecast.session import build_session  # noqa: E402
from tidecast.sources import fixtures, read_prices  # noqa: E402
from tidecast.sources.prices import fixture_prices  # noqa: E402


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(name: str, text: str, full: bool) -> None:
    tree = text.split("\n\n")[0]
    print(f"== {name} ==")
    print(tree if full else "\n".join(l for l in tree.splitlines()
                                      if re.search(r"Exchange|Window|Sort |Join|Aggregate|Scan|Generate", l)))
    print("bucketed scan:", re.findall(r"Bucketed: (\w+)", text))
    print("exchanges:", re.findall(r"Arguments: (hashpartitioning\([^)]*\))", text))
    print("pushed:", re.findall(r"PushedFilters: (.*)", text))
    print("read schema:", re.findall(r"ReadSchema: (.*)", text))
    print("python in plan:", any(k in text for k in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython")))
    print()


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    full = "--full" in sys.argv
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    path = tempfile.mkdtemp(prefix="tidecast-explain-") + "/prices"
    fixture_prices(spark, sf).write.parquet(path)
    prices = read_prices(spark, path)
    req = fixtures.requests(spark, sf)
    res = train.train_all(prices, req, fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS)
    summary("train_all (models), Parquet price table", formatted(res.models), full)
    fr = fplan.forecast_all(prices, req, res.models, fixtures.AS_OF, fixtures.HISTORY_DAYS)
    summary("forecast_all (forecasts), Parquet price table", formatted(fr.forecasts), full)
    from tidecast.sources import write_bucketed_prices
    write_bucketed_prices(fixture_prices(spark, sf), "explain_prices", 16, path=path + "_bucketed")
    bucketed = read_prices(spark, "explain_prices", fmt="table")
    res_b = train.train_all(bucketed, req, fixtures.AS_OF, now=fixtures.NOW, horizons=fixtures.HORIZONS)
    summary("train_all (models), bucketed price table", formatted(res_b.models), full)


if __name__ == "__main__":
    main()
