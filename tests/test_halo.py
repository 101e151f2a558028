"""Windows over blocks with a halo give what windows over whole series give."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import frame
from tidecast.operators import features, halo


def _gappy(ticker, n, seed):
    """A series with missing days, and a few closes that are null."""
    rng = random.Random(seed)
    days = sorted(rng.sample(range(3 * n), n))
    return [(ticker, (date(2000, 1, 1) + timedelta(days=d)).isoformat(), None if rng.random() < 0.02 else round(rng.uniform(50, 150), 2))
            for d in days]


@pytest.fixture(scope="module")
def prices(spark):
    return frame(spark, _gappy("A", 700, 1) + _gappy("B", 130, 2) + _gappy("C", 40, 3)).cache()


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_positions_count_earlier_rows(spark, prices):
    got = halo.positions(prices, bucket_days=50).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "pos"))).alias("p"))
    for r in got.collect():
        assert [x.pos for x in r.p] == list(range(len(r.p)))


@pytest.mark.parametrize("block_rows", [17, 64, 100, 4096])
def test_features_equal_whole_series(spark, prices, block_rows):
    want = features.build_features(prices, warm_up=False)
    got = halo.build_features(prices, warm_up=False, block_rows=block_rows, bucket_days=90)
    key = F.struct("ticker", "date")
    assert got.columns == want.columns
    as_text = [F.col(c).cast("string").alias(c) for c in want.columns]  # nulls sort
    assert want.select(*as_text).exceptAll(got.select(*as_text)).isEmpty() and got.count() == want.count()
    assert got.select(key).distinct().count() == got.count()


@pytest.mark.parametrize("block_rows", [16, 128])
def test_targets_equal_whole_series(spark, prices, block_rows):
    feats = features.build_features(prices)
    want = features.add_targets(feats, [1, 30, 90])
    got = halo.add_targets(halo.build_features(prices, block_rows=block_rows, bucket_days=64), [1, 30, 90],
                           block_rows=block_rows, bucket_days=64)
    assert got.columns == want.columns and _rows(got) == _rows(want) and want.count() > 0


def test_one_series_runs_in_many_tasks(spark, prices):
    """The rows of a single ticker lie in several window partitions, and more than one task has some."""
    one = prices.where("ticker = 'A'")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = features.build_features(one).select(F.spark_partition_id().alias("p")).distinct().count()
        split = halo.build_features(one, block_rows=64, bucket_days=90).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert whole == 1 and split >= 2
    plan = halo.build_features(one, block_rows=64)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker#" in plan and "_block" in plan


def test_empty_table(spark, prices):
    none = prices.limit(0)
    assert halo.add_targets(halo.build_features(none), [5]).count() == 0
