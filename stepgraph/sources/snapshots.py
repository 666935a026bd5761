"""Checkpoints and versioned snapshots of the store's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir as Spark uses it, a folder of our own only where that is unset on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stepgraph-"))
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer files than there are; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path that no other query uses, in the folder that all executors share."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written to spark.checkpoint.dir without lineage."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


class SnapshotStore:
    """Tables as folders of versions; a commit writes every table anew and then moves one pointer.

    All paths go through Spark, so any file system it reads will do.  Readers see the version the
    pointer names; a commit based on another version than the current one is refused.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """0 before the first commit."""
        folder = self._path(f"{self.base}/pointers")
        if not self._fs.exists(folder):
            return 0
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(folder)], default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}/v={version or self.current()}")

    def appended(self, name: str, version: int | None = None) -> DataFrame:
        """What all commits up to a version wrote under a name, for tables of which each commit adds a part."""
        rows = self.spark.read.parquet(f"{self.base}/{name}")
        return rows.filter(F.col("v") <= (version or self.current())).drop("v")

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        """Writes the tables as version expected + 1; the pointer is created once, so one of two writers wins."""
        if self.current() != expected:
            raise RuntimeError(f"version {self.current()} is current, not {expected}")
        version = expected + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.base}/{name}/v={version}")
        if not self._fs.createNewFile(self._path(f"{self.base}/pointers/{version}")):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version
