"""Exact deduplication by stateful streaming.

The digests of the normalised texts flow through a Structured Streaming
aggregation whose state lives in RocksDB (on disk, checkpointed to the shared
folder, never expired).  Per digest the state holds the smallest stable
identifier, the locator of its content and the number of rows seen.  Spark
combines rows of one digest before the shuffle, so a digest that a third of
all rows carry reaches the state as one row per task.

A digest hit is only a candidate: the full normalised bytes of every hit are
compared with the content its locator names.  Digests with unequal bytes are
resolved by grouping on the texts themselves.

Defined results: null text counts as empty; an empty table gives an empty
result; a null doc_id sorts after all others; of rows that repeat both doc_id
and text exactly one is kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, parted, shared_path, shared_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = "row_id long, doc_id long, digest string, locator string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def keep_first(keys: DataFrame) -> DataFrame:
    """The stateful operator, on a streaming (or static) frame of KEYS: per
    digest the first row in (doc_id, row_id) order with its locator, and the count."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "locator"))
    return keys.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))


def run_stream(keys_path: str, n_files: int, spark, micro_batches: int = 2) -> DataFrame:
    """Streams the written KEYS table through ``keep_first`` until it is drained
    and returns the final state (read from the state store's checkpoint)."""
    own = spark.newSession()  # streaming settings stay out of the caller's session
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # open files follow running tasks, not state
    per_batch = max(1, math.ceil(n_files / micro_batches))
    stream = own.readStream.schema(KEYS).option("maxFilesPerTrigger", per_batch).parquet(keys_path)
    place = shared_path(spark, "dedup-state")
    query = (keep_first(stream).writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", place).trigger(availableNow=True).start())
    query.awaitTermination()
    state = own.read.format("statestore").load(place)
    first = F.col("value").getField(state.schema["value"].dataType.names[0])
    count = F.col("value").getField(state.schema["value"].dataType.names[1])
    flat = state.select(F.col("key.digest").alias("digest"), first["doc_id"].alias("keep_id"),
                        first["row_id"].alias("keep_row"), first["locator"].alias("locator"),
                        count.alias("group_size"))
    path = shared_path(spark, "dedup-first")
    flat.write.parquet(path)
    return spark.read.schema(flat.schema).parquet(path)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, micro_batches: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256 and locator (the file that holds the kept content)."""
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = shared_table(base.select(F.monotonically_increasing_id().alias("row_id"), "doc_id",
                                    digest(norm).alias("digest"), F.input_file_name().alias("locator"),
                                    sha256(norm).alias("text_sha256")), "dedup-keys")
    files = keys.inputFiles()
    if not files:
        return keys.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), "text_sha256", "locator")
    first = run_stream(files[0].rsplit("/", 1)[0], len(files), spark, micro_batches)

    # full bytes of every hit against the content that the state points to
    shared = first.where("group_size > 1").select("digest", F.col("keep_id").alias("at"))
    texts = base.select("doc_id", norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    hits, _ = parted(texts, "digest", shared)
    hits = hits.join(shared, "digest")
    content = hits.where(F.col("doc_id").eqNullSafe(F.col("at"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    unequal = shared_table(hits.join(content, "digest").where(F.col("norm") != F.col("kept_norm"))
                           .select("digest").distinct(), "dedup-unequal")

    group = keys.join(first.withColumnRenamed("locator", "at"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_id") == F.col("keep_row"))
    plain = group.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256",
                         F.col("at").alias("locator"), "digest")
    if unequal.isEmpty():
        return plain.drop("digest")
    plain = plain.join(unequal, "digest", "left_anti").drop("digest")
    return plain.unionByName(_by_text(texts.join(unequal, "digest", "left_semi")))


def _by_text(texts: DataFrame) -> DataFrame:
    """Exact grouping on the texts (for digests that unequal texts share)."""
    exact = sha256(F.col("norm"))
    order = Window.partitionBy("norm").orderBy(F.col("doc_id").asc_nulls_last())
    of = texts.withColumn("rank", F.row_number().over(order)).withColumn(
        "keep_id", F.first("doc_id").over(order)).withColumn(
        "group_size", F.count(F.lit(1)).over(Window.partitionBy("norm")))
    return of.select("doc_id", "keep_id", "group_size", (F.col("rank") == 1).alias("kept"),
                     exact.alias("text_sha256"), F.lit(None).cast("string").alias("locator"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, all columns kept."""
    result = shared_table(exact_dedup(docs), "dedup-result")
    gone = result.where("not kept").select("doc_id")
    wide = docs.withColumn("__id", F.col("doc_id").cast("long"))
    doubtful, stay = parted(wide, "__id", gone)
    kept = result.where("kept").select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha"))
    rows = doubtful.withColumn("__of", sha256(normalised(F.col("text"))))
    same = (F.col("__id").eqNullSafe(F.col("__keep"))) & (F.col("__of") == F.col("__sha"))
    out = rows.join(kept, same, "left_semi")
    # rows that repeat an id and its text: one stays
    again = (result.groupBy("doc_id", "text_sha256").count().where("count > 1")
             .select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha")))
    if again.isEmpty():
        return stay.select(*docs.columns).unionByName(out.select(*docs.columns))
    single = out.join(again, same, "left_anti")
    repeated = out.join(again, same, "left_semi").dropDuplicates(["doc_id", "__of"])
    return stay.select(*docs.columns).unionByName(single.unionByName(repeated).select(*docs.columns))
