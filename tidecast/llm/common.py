"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only (``lower`` would also change other letters)."""
    return F.translate(c, UPPER, LOWER)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage
    with compressed, column-pruned files that survive lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MARKS = 1 << 20  # values of the key hash below: bounds what is broadcast


def mark(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS)).cast("int")


def parted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may be among ``keys`` (one column), and those
    whose key cannot be.  Decided by a hash with MARKS values, whose set is broadcast, so
    wide rows that a join would not keep are spared its shuffle; beyond some millions of
    keys nearly all rows are in the first part and the join does all the work."""
    marks = F.broadcast(keys.select(mark(keys[keys.columns[0]]).alias("__mark")).distinct())
    same = mark(key) == F.col("__mark")
    return rows.join(marks, same, "left_semi"), rows.join(marks, same, "left_anti")


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it holds, Python tasks get at most so many rows at once (wide rows of
    thousands of texts would else pile up in both processes); restored afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_mod(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor`` (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space, as the
    number of places where such a run starts."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    gaps = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    lead = F.startswith(flat, F.lit(" ")).cast("int")
    tail = F.endswith(flat, F.lit(" ")).cast("int")
    words = gaps + 1 - lead - tail
    return F.when(F.length(flat) == 0, 0).when(flat == " ", 0).otherwise(words).cast("long")
