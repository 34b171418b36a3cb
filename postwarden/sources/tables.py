"""Tables as versioned Parquet folders: a version is whole before it can be read."""

from __future__ import annotations

import functools
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="postwarden-")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or _own_folder()).rstrip("/")


class Tables:
    """Named tables under a folder; each write is a new version, named by its batch, readers take the last whole one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self, name: str) -> list[int]:
        fs, at = self._fs(f"{self.root}/{name}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        whole = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/{name}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in whole)

    def last_batch(self, name: str) -> int:
        return max(self.versions(name), default=-1)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{self.last_batch(name)}")

    def write(self, name: str, rows: DataFrame, batch: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
        number = self.last_batch(name) + 1 if batch is None else batch
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/v{number}")

    def prune(self, name: str, keep: int = 2) -> None:
        for v in self.versions(name)[:-keep]:
            fs, at = self._fs(f"{self.root}/{name}/v{v}")
            fs.delete(at, True)
