"""Spark session helpers.

On a cluster the session is created by the platform; ``configure`` only fills in
settings that are still unset, so cluster-wide choices (checkpoint directory,
shuffle partitions, broadcast threshold) are never overridden.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set runtime defaults that are not already set by the caller."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, read from ``spark.checkpoint.dir``.

    Where it is unset a local master, whose driver and executors are one process,
    gets a scratch folder; a cluster must name a folder that all executors share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cribra-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder: application, name and a uuid."""
    return (f"{checkpoint_dir(spark).rstrip('/')}/cribra/{spark.sparkContext.applicationId}/"
            f"{name}-{uuid.uuid4().hex}")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scan_splits(spark: SparkSession, split_bytes: int | None):
    """Bounds a task's part of a file for the scans that are planned and run inside."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    if split_bytes is not None:
        spark.conf.set(key, str(split_bytes))
    try:
        yield
    finally:
        if split_bytes is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cribra") -> SparkSession:
    """Local session for tests and the bench (UI off, no extra servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CRIBRA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
