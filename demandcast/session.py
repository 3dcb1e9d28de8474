"""SparkSession helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Rows that a task of an aggregate over rows of a few numbers may hold.
TASK_ROWS = 500_000

# Settings every session created here gets. On a cluster, pass a configured
# builder or an existing session instead; nothing below is machine-specific.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Window stages are CPU-bound on little shuffle data: let AQE keep small
    # partitions instead of merging them below the core count.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins of two panel versions on (store, item, date) can reuse the
    # (store, item) hash partitioning both sides already have from the series
    # windows, instead of shuffling both again on all three keys.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "demandcast",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with ``DEFAULT_CONF``.

    Without ``master``, a master set by ``spark-submit`` (or any Spark conf)
    is kept; only when none is configured is the session local
    (``local[$BENCH_CPUS]`` or ``local[*]``). An active session is returned
    untouched apart from the checkpoint directory (see
    :func:`ensure_checkpoint_dir`).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    if master is None and not SparkConf().contains("spark.master"):
        # no spark-submit / cluster master configured: a local session
        cpus = os.environ.get("BENCH_CPUS")
        master = f"local[{cpus}]" if cpus else "local[*]"
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make reliable checkpoints possible and return their directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is. Only a local-mode session without the setting (tests, the
    bench) gets a fresh temporary folder. A cluster session without the
    setting raises: a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # local-cluster has separate executors, so it counts as a cluster here
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder "
                "(HDFS/S3/ABFS) for reliable checkpoints")
        configured = tempfile.mkdtemp(prefix="demandcast-ckpt-")
    elif configured.startswith(("file:", "/")) and not sc.master.startswith("local"):
        raise RuntimeError(
            f"spark.checkpoint.dir is {configured}, a folder of each machine's own; "
            "name a shared one (HDFS/S3/ABFS)")
    sc.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: the session's number, or more so that each holds few.

    For ``repartition``, whose number AQE keeps: partitions of small rows that it merges
    by their compressed size make hash tables that grow with the input.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def checkpointed(df):
    """``df.checkpoint()`` (reliable, eager) into the shared checkpoint folder.

    Cuts the lineage so later jobs, and a recomputation after a lost executor,
    start from the written rows. Never ``localCheckpoint``: those blocks die
    with their executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
