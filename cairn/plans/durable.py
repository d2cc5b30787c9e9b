"""Intermediate tables that survive the loss of executors.

They are written to the folder that the cluster shares and names in ``spark.checkpoint.dir``; only where that setting is unset (tests) a
folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.TemporaryDirectory(prefix="cairn-")
        atexit.register(folder.cleanup)
        _own[app] = f"file://{folder.name}"
    return _own[app]


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove a folder when the application ends; before that any job may read it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


class Durable:
    """A table written once; ``df`` reads it back. ``drop()`` removes its files when nothing will read it any more."""

    def __init__(self, df: DataFrame, name: str = "table"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/cairn/{name}-{uuid.uuid4().hex}"
        # The shuffle files of what led to the table are of no more use once it is written.
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before else self.spark.conf.unset(_CLEANUP)
        delete_at_exit(self.spark, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    return Durable(df, name).df
