import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidecast.session import build_session
    ckpt = tempfile.mkdtemp(prefix="tidecast-test-ckpt-")
    s = build_session("local[4]", shuffle_partitions=8, checkpoint=ckpt)
    yield s


def frame(spark, rows, schema="ticker string, date string, close double"):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    if "date" in df.columns:
        df = df.withColumn("date", F.to_date("date"))
    return df
