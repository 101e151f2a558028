"""Every registered query against its DuckDB oracle on the smallest scale."""

import math

import duckdb
import pytest

from tests.conftest import SF001

import __spark_entry__ as entry
from tidecast.plans import catalog, oracle

TABLES = ("lineitem", "supplier", "orders", "customer", "events")


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'Asia/Tokyo'")  # the oracle must not depend on the session zone
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF001)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracle.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    exp = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == exp


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ticker", "forecast_days", "step", "date", "predicted_price"]
