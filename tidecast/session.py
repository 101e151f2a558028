"""Session helpers: a configured local session for tests/bench, and the
shared checkpoint folder a job uses to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidecast", checkpoint: str | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    settings below are the ones that matter at any scale: AQE (runtime
    coalescing, skew splitting, broadcast conversion by *measured* size),
    a UTC session zone (all instants are UTC, market time is explicit),
    and no UI server.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = bool(master and master.startswith("local"))
    if shuffle_partitions is None and local:
        shuffle_partitions = 8
    if shuffle_partitions is not None:  # on a cluster, leave spark-submit's setting alone
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    if local:
        builder = builder.config("spark.driver.memory", os.environ.get("TIDECAST_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions_for(shuffled_bytes: int, total_cores: int,
                           target_bytes: int = 128 * 1024 * 1024) -> int:
    """Initial ``spark.sql.shuffle.partitions`` for a job whose largest
    shuffle moves ``shuffled_bytes`` (for training: the price rows in the
    look-back window, about 30 bytes a row): partitions of ~``target_bytes``
    so a window task's sort and spill stay well inside executor memory, and
    never fewer than two waves of tasks over the cluster.  AQE then merges
    partitions that turn out small."""
    by_size = -(-int(shuffled_bytes) // int(target_bytes))
    return max(2 * int(total_cores), by_size)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names storage every executor can reach; we
    only pick our own (a fresh scratch folder) when it is unset, as in
    local tests.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder every executor can reach "
                               "(a machine-local folder would not survive a lost executor)")
        conf_dir = tempfile.mkdtemp(prefix="tidecast-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a
    local checkpoint: it would not survive a lost executor)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
