"""Tables of the day-by-day training (``plans.incremental``) below a folder.

``rows`` is partitioned by run and by block of row numbers, so the few blocks that a
day touches are the only folders read.  A run that is repeated replaces its own rows, and a
reader takes the rows of runs up to its own day, so what a failed later run left behind is
never read.  The other tables are small, written once under a fresh name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


class BookTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes the frame and returns it as read."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def append(self, rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
        """Adds a run's rows (with a column ``block``); returns all rows up to the run, and the run's."""
        path = f"{self.root}/rows"
        rows.write.mode("overwrite").partitionBy("block").parquet(f"{path}/run={as_of}")
        schema = StructType([f for f in rows.schema if f.name != "block"]).add("run", StringType()).add(rows.schema["block"])
        whole = self.spark.read.schema(schema).option("basePath", path).parquet(path)
        run = F.lit(str(as_of))
        return whole.where(F.col("run") <= run).drop("run"), whole.where(F.col("run") == run).drop("run")
