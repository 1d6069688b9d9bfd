"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that reliable checkpoints have a home.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is used.  Only a session in local mode, where
    all executors live on this machine, gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="lexigrove-checkpoint-")
        sc.setCheckpointDir(folder)
        _delete_on_exit(spark, folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there afterwards.

    Where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, Spark removes it when it is no longer in use.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, folder)
    return folder


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
