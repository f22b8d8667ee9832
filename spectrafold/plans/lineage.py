"""Cutting the lineage of iterative plans, and the shared folder that this takes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where all of Spark is in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    at = sc._jsc.sc().getCheckpointDir()
    return at.get() if at.isDefined() else tempfile.mkdtemp(prefix="spectrafold-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Spark deletes the files of checkpoints that are no longer used where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files, and checkpoints, of tables that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with little to do puts off while the files add up.
    """
    gc.collect()
    spark._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is, if it exists."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
