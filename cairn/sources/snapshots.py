"""Tables that are replaced as a whole: each version is a new folder, and the last one with a mark of success is read.

Readers of an older version are not disturbed, a lost executor or driver leaves at worst a folder without a mark, and a token makes a retried batch write nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """(number, folder) of the published versions, ascending."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))]
        done = [n for n in names if n.startswith("v") and self._files.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(n[1:].split("-")[0]), n) for n in done)

    def read(self, version: int | None = None) -> DataFrame | None:
        found = [n for v, n in self.versions() if version is None or v == version]
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def publish(self, df: DataFrame, token: str = "") -> int:
        """Write a new version; with a token that is already published nothing is written."""
        known = self.versions()
        if token:
            for number, name in known:
                if name.endswith(f"-{token}"):
                    return number
        number = known[-1][0] + 1 if known else 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{number:08d}" + (f"-{token}" if token else ""))
        return number

    def prune(self, keep: int = 2) -> None:
        for _, name in self.versions()[:-keep]:
            self._files.delete(self._path(f"{self.path}/{name}"), True)
