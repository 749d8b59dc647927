"""Session helpers: local sessions for tests, reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **extra) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weekpanel")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # no Python stack capture per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Only a master of one process, ``local`` or ``local[n]`` (tests), may fall
    back to a temporary folder: on a cluster, also a ``local-cluster``, a
    machine-local folder is not shared and is lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if configured is None:
        current = context.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder")
        configured = tempfile.mkdtemp(prefix="weekpanel-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a CPU-heavy step on an input with few splits.

    Inputs with at least one split per core (any large table) pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_checked(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast a small aggregate once its size is known.

    The table is materialised and counted; beyond ``max_rows`` it is returned
    without a hint and joins by shuffle (with skew handling by AQE).
    """
    table = cut_lineage(df)
    return F.broadcast(table) if table.count() <= max_rows else table


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably; the files survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
