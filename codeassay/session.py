"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without the setting falls back to a temporary folder; on a cluster
    such a folder would be lost with its machine, so there it is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="codeassay-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/codeassay-{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Later stages see the same rows after any loss, and each reads only the columns it needs.
    ``discard`` removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._stable_path = path
    return written


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop knows them."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(sc._jsc.hadoopConfiguration()), found


def discard(*written: DataFrame) -> None:
    """Remove the tables that ``stable`` wrote for these frames; nothing may read them any more."""
    for df in written:
        fs, path = hadoop_path(df.sparkSession, df._stable_path)
        fs.delete(path, True)
