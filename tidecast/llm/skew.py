"""Many-to-one look-ups whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000   # a key is hot with more than 1/SHARE of the rows, so at most SHARE keys are
LEAST = 2000   # and with more rows than this
WAYS = 32      # tasks that a hot key is dealt to


def look_up(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (a table, read more than once) joined to ``table`` (one row a key of ``on``, no
    nulls in it).  Hot keys are counted first; their rows are dealt by a hash of the row to WAYS
    tasks and the table's row goes to each.  What is broadcast are the hot keys alone, at most
    SHARE of them at any size."""
    total = rows.count()
    if total <= LEAST:  # no key can be hot
        return rows.join(table, on, how)
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(LEAST, total // SHARE))
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("__hot")))
    dealt = rows.join(hot, on, "left").withColumn(
        "__way", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(WAYS)).cast("int")).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(hot, on, "left").withColumn("__way", F.explode(every)).drop("__hot")
    return dealt.join(copies, [*on, "__way"], how).drop("__way")
