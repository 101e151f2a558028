"""S2 / S3 / S4 / S5 / S6 sinks: the registry and job outputs as Parquet.

Layout under one registry root (any Hadoop-compatible path):

* ``models/bucket=<b>/`` append-only model versions (``schema.MODEL``), by a hash of
  (ticker, forecast_days): look-ups read the buckets of their keys alone;
* ``tombstones/`` append-only deletions (``schema.TOMBSTONE``);
* ``run_log/``    append-only training run records (``schema.RUN_LOG``);
* ``latest/snapshot=<time>-<id>/`` a cache: the newest live version per key
  over the model files listed in ``covered/snapshot=<time>-<id>/``.  Readers
  take the newest complete snapshot, read the model files it does not list
  beside it, and apply all tombstones, so neither a late writer nor a
  missing snapshot can hide a version or bring a deleted one back.  Names
  are unique, so writers never collide.

Appends go through Spark's file commit protocol: a failed or retried job
leaves no partial version visible, which is what the temp-file-and-rename
of the single-file store gave.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .. import schema
from ..errors import RegistryNotFound


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def empty(spark: SparkSession, struct) -> DataFrame:
    """An empty frame of ``struct`` built from a JVM leaf (a local Python
    list would be scanned by Python workers in every plan that uses it)."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields])


def _read(spark: SparkSession, path: str, struct) -> DataFrame:
    fs, p = _fs(spark, path)
    if not fs.exists(p):  # nothing written yet; any other fault rises
        return empty(spark, struct)
    return spark.read.schema(struct).parquet(path)


def require_root(spark: SparkSession, root: str) -> None:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        raise RegistryNotFound(root)


def _conform(df: DataFrame, struct) -> DataFrame:
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in struct.fields])


KEY_BUCKETS = 16
_STORED_MODEL = StructType([*schema.MODEL.fields]).add("bucket", IntegerType())
_MODEL_NAMES = [f.name for f in schema.MODEL.fields]


def key_bucket() -> Column:
    """The folder of a key's versions."""
    return F.pmod(F.xxhash64(F.col("ticker"), F.col("forecast_days").cast("int")), F.lit(KEY_BUCKETS)).cast("int")


def read_models(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, _path(root, "models"), _STORED_MODEL).select(*_MODEL_NAMES)


def read_models_of(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """The versions of the requested keys.  Only the folders of their buckets are listed
    for the scan; which those are is at most ``KEY_BUCKETS`` numbers."""
    keys = requests.select("ticker", F.col("forecast_days").try_cast("int").alias("forecast_days")).where(
        F.col("ticker").isNotNull() & F.col("forecast_days").isNotNull()).distinct()
    buckets = sorted(r[0] for r in keys.select(key_bucket()).distinct().collect())
    rows = _read(spark, _path(root, "models"), _STORED_MODEL).where(F.col("bucket").isin(buckets))
    return rows.join(keys, ["ticker", "forecast_days"], "left_semi").select(*_MODEL_NAMES)


def read_tombstones(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, _path(root, "tombstones"), schema.TOMBSTONE)


def read_run_log(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, _path(root, "run_log"), schema.RUN_LOG)


def append_models(models: DataFrame, root: str) -> None:
    rows = _conform(models, schema.MODEL).withColumn("bucket", key_bucket())
    rows.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket").parquet(_path(root, "models"))


def append_tombstones(tombstones: DataFrame, root: str) -> None:
    _conform(tombstones, schema.TOMBSTONE).write.mode("append").parquet(_path(root, "tombstones"))


def append_run_log(run_log: DataFrame, root: str) -> None:
    _conform(run_log, schema.RUN_LOG).write.mode("append").parquet(_path(root, "run_log"))


def write_forecasts(forecasts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Forecasts partitioned by horizon (readers prune by ``forecast_days``)."""
    # rebalance gathers a horizon's rows into few files and, unlike a plain
    # repartition by the column, splits a horizon that holds most of them
    rows = _conform(forecasts, schema.FORECAST).hint("rebalance", F.col("forecast_days"))
    rows.write.mode(mode).partitionBy("forecast_days").parquet(path)


def read_forecasts(spark: SparkSession, path: str, horizons=None) -> DataFrame:
    """Forecasts as written; with ``horizons`` only their partitions are read."""
    rows = spark.read.schema(schema.FORECAST).parquet(path)
    return rows if horizons is None else rows.where(F.col("forecast_days").isin([int(h) for h in horizons]))


# --- latest snapshot ---------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _snapshot_paths(spark: SparkSession, root: str) -> list[str]:
    """Complete snapshots (with ``_SUCCESS``), oldest first (metadata only)."""
    fs, base = _fs(spark, _path(root, "latest"))
    if not fs.exists(base):
        return []
    out = []
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("snapshot=") and \
                fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append((name, st.getPath().toString()))
    return [p for _, p in sorted(out)]


def model_files(spark: SparkSession, root: str) -> list[str]:
    """The data files of ``models/`` (the listing that any read makes)."""
    return sorted(read_models(spark, root).inputFiles())


def _covered(spark: SparkSession, root: str) -> tuple[str, set[str]] | None:
    paths = _snapshot_paths(spark, root)
    if not paths:
        return None
    listed = spark.read.schema("file string").parquet(_path(root, f"covered/{paths[-1].rsplit('/', 1)[1]}"))
    return paths[-1], {r.file for r in listed.collect()}


def read_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None] | None:
    """The newest snapshot and the versions in model files that it does not cover."""
    found = _covered(spark, root)
    if found is None:
        return None
    path, listed = found
    since = [f for f in model_files(spark, root) if f not in listed]
    reader = spark.read.schema(schema.MODEL)
    return reader.parquet(path), reader.parquet(*since) if since else None


def uncovered_files(spark: SparkSession, root: str) -> int:
    found = _covered(spark, root)
    return len(set(model_files(spark, root)) - (found[1] if found else set()))


def write_snapshot(latest: DataFrame, files: list[str], root: str) -> str:
    """Write a snapshot over the model files ``files``; returns its path."""
    spark = latest.sparkSession
    name = f"snapshot={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(_path(root, f"covered/{name}"))
    path = _path(root, f"latest/{name}")  # complete only once its file list is
    _conform(latest, schema.MODEL).write.mode("errorifexists").parquet(path)
    return path


def prune_snapshots(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Retention for ``latest/``: remove all but the ``keep`` newest complete
    snapshots (history, tombstones and run log are never touched).  Call it
    from a maintenance job, not while another job may still be reading an
    old snapshot.  Returns the removed paths."""
    if keep < 1:
        raise ValueError("keep at least one snapshot")
    paths = _snapshot_paths(spark, root)
    removed = paths[:-keep]
    for path in removed:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return removed

